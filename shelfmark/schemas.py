"""Declared schemas, and the column-name bindings that operators take."""

from dataclasses import dataclass

from pyspark.sql import types as T

CATEGORIES_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("slug", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("name_am", T.StringType()),
    T.StructField("emoji", T.StringType()),
    T.StructField("subtitle", T.StringType()),
    T.StructField("icon_bg", T.StringType()),
    T.StructField("sort_order", T.IntegerType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

ITEMS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("category_id", T.StringType()),
    T.StructField("name", T.StringType(), False),
    T.StructField("name_am", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_am", T.StringType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("emoji", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("badge", T.StringType()),
    T.StructField("is_available", T.BooleanType()),
    T.StructField("sort_order", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

INFO_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("name_am", T.StringType()),
    T.StructField("tagline", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("phone_label", T.StringType()),
    T.StructField("logo_url", T.StringType()),
    T.StructField("header_emoji", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("footer_text", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

OWNERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("email", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

USERS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("email", T.StringType()),
    T.StructField("email_confirmed_at", T.TimestampType()),
])


@dataclass(frozen=True)
class ItemCols:
    id: str = "id"
    category: str = "category_id"
    name: str = "name"
    description: str = "description"
    price: str = "price"
    badge: str = "badge"
    available: str = "is_available"
    order: str = "sort_order"


@dataclass(frozen=True)
class CategoryCols:
    id: str = "id"
    slug: str = "slug"
    name: str = "name"
    emoji: str = "emoji"
    active: str = "is_active"
    order: str = "sort_order"


ITEMS = ItemCols()
CATEGORIES = CategoryCols()
