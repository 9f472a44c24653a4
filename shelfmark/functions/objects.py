"""Rules for object names, addresses and tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import as_col, filled


def object_ext(file_name) -> Column:
    """Text after the last dot (all of it without one, 'jpg' if empty), letters and digits only."""
    tail = F.coalesce(filled(F.substring_index(as_col(file_name), ".", -1)), F.lit("jpg"))
    return F.regexp_replace(F.lower(tail), r"[^a-z0-9]", "")


def object_key(file_name, saved_ms, row_id, folder: str = "items") -> Column:
    """Key under a folder. The tail hashes the row id, so a retried task gives the same key."""
    tail = F.substring(F.md5(as_col(row_id).cast("string").cast("binary")), 1, 6)
    stem = F.concat_ws("-", as_col(saved_ms).cast("string"), tail)
    return F.concat(F.lit(folder + "/"), stem, F.lit("."), object_ext(file_name))


def object_key_from_url(url, bucket: str = V.OBJECT_BUCKET) -> Column:
    url, marker = as_col(url), f"/{bucket}/"
    at = F.locate(marker, url)
    return F.when(at > 0, F.substring_index(F.substring(url, at + len(marker), F.length(url)), "?", 1))


def upload_valid(size, media, max_bytes: int = V.MAX_IMAGE_BYTES) -> Column:
    """'ok', or why the upload is refused; size is tested first."""
    is_image = F.coalesce(as_col(media), F.lit("")).rlike(V.IMAGE_TYPE_PATTERN)
    return F.when(as_col(size) > max_bytes, F.lit("too_large")) \
        .when(~is_image, F.lit("not_image")).otherwise(F.lit("ok"))


def media_type(path) -> Column:
    extension = F.regexp_extract(F.lower(as_col(path)), r"[^/](\.[^./]*)\z", 1)
    table = F.create_map(*[F.lit(x) for pair in V.MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit(V.DEFAULT_MEDIA_TYPE))


def url_base(url) -> Column:
    return F.regexp_replace(as_col(url), r"/+\z", "")


def url_matches(url, pattern: str) -> Column:
    """Does the address, without trailing slashes, match the whole pattern in any letter case?"""
    return F.coalesce(url_base(url).rlike(rf"(?i)\A(?:{pattern})\z"), F.lit(False))


def token_role(token) -> Column:
    """Role claimed in the middle part of a dotted token, null where it cannot be read."""
    middle = F.translate(F.split_part(as_col(token), F.lit("."), F.lit(2)), "-_", "+/")
    payload = F.try_to_binary(middle, F.lit("base64")).cast("string")
    return F.get_json_object(payload, "$.role")


def token_class(token, public_role: str = V.PUBLIC_ROLE, forbidden: str = V.FORBIDDEN_ROLE) -> Column:
    role = token_role(token)
    return F.when(role == public_role, F.lit("ok")) \
        .when(role == forbidden, F.lit("forbidden")).otherwise(F.lit("unknown"))
