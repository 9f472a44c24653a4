"""A small catalog with the shape of a menu: 7 categories, 27 items, one info row. All texts are invented."""

CATEGORY_COLUMNS = "slug string, name string, emoji string, subtitle string, icon_bg string, sort_order int"
# fixed values: the slugs for which icon colours are fixed
SLUGS = ["breakfast", "burger", "coffee", "fastfood", "juice", "main", "pizza"]
CATEGORIES = [
    ("juice", "Pressed to order", "🧃", "Six fruits", "#111111", 1),
    ("main", "Out of the pan", "🥘", None, None, 2),
    ("coffee", "Beans and leaves", "🫖", None, None, 3),
    ("pizza", "Round and flat", "🫓", "Stone baked", None, 4),
    ("fastfood", "To carry away", "🥡", None, None, 5),
    ("breakfast", "Before noon", "🥞", None, None, 6),
    ("burger", "Between two halves", "🥪", None, None, 7),
]
SIZES = {"pizza": 5, "burger": 5, "juice": 6, "coffee": 5, "breakfast": 2, "main": 2, "fastfood": 2}
NEW = {("juice", 2), ("juice", 6), ("coffee", 4), ("burger", 2), ("pizza", 5)}
HOT = {("burger", 4)}
AMHARIC = {"breakfast": "ቁጥር አንድ", "main": "ቁጥር ሁለት"}

ITEM_COLUMNS = ("slug string, name string, description string, description_am string, price decimal(10,2), "
                "emoji string, badge string, sort_order int")


def items():
    from decimal import Decimal

    rows = []
    for slug, size in SIZES.items():
        for n in range(1, size + 1):
            plain = slug in ("coffee", "fastfood") or slug in AMHARIC
            badge = "new" if (slug, n) in NEW else "hot" if (slug, n) in HOT else None
            price = Decimal(450) if (slug, n) == ("pizza", 1) else Decimal(100 + 10 * n)
            rows.append((slug, f"{slug.title()} No. {n}", None if plain else f"made of {slug} {n}",
                         AMHARIC.get(slug), price, None, badge, n))
    return rows


INFO_COLUMNS = "id int, name string, name_am string, tagline string, phone string, phone_label string, currency string"
INFO = [(1, "Test House", "ቤት", "Good things", "+1 555 01 02", "", "ETB")]
USER_COLUMNS = "id string, email string, email_confirmed_at timestamp"
