"""What a reader sees for an item, a category or the header."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import as_col, filled, phone_uri


def is_on(flag) -> Column:
    """Only a literal false turns a flag off."""
    return F.coalesce(as_col(flag), F.lit(True))


def or_zero(number) -> Column:
    return F.coalesce(as_col(number), F.lit(0))


def currency_or_default(currency) -> Column:
    return F.coalesce(filled(currency), F.lit(V.DEFAULT_CURRENCY))


def format_price(price, currency=None) -> Column:
    """Whole prices without decimals, others with two; a price that is no number gives ''."""
    currency = F.lit(None).cast("string") if currency is None else as_col(currency)
    amount = F.coalesce(as_col(price), F.lit(0)).try_cast("decimal(20,2)")
    shown = F.when(amount == F.floor(amount), amount.cast("decimal(20,0)").cast("string")) \
        .otherwise(amount.cast("string"))
    label = F.concat(shown, F.lit(" "), currency_or_default(currency))
    return F.coalesce(label, F.lit(""))


def format_price_raw(price, currency=None) -> Column:
    """The price as the number prints, without trailing zeros."""
    currency = F.lit(None).cast("string") if currency is None else as_col(currency)
    digits = as_col(price).cast("decimal(20,2)").cast("string")
    shown = F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    return F.concat(shown, F.lit(" "), currency_or_default(currency))


def display_badge(available, badge) -> Column:
    badge = as_col(badge)
    label = F.when(~is_on(available), F.lit(V.SOLD_OUT))
    for code, text in V.BADGE_LABELS.items():
        label = label.when(badge == code, F.lit(text))
    return label.otherwise(F.lit(""))


def status_pills(available, badge) -> Column:
    badge = as_col(badge)
    pills = [F.when(badge == code, F.lit(text)) for code, text in V.BADGE_LABELS.items()]
    return F.array_compact(F.array(*pills, F.when(~is_on(available), F.lit(V.SOLD_OUT))))


def display_icon(image_url, emoji, category_emoji=None) -> Column:
    """First filled of picture, own emoji, category emoji (where the view has one), default."""
    choices = [image_url, emoji] + ([] if category_emoji is None else [category_emoji])
    return F.coalesce(*[filled(c) for c in choices], F.lit(V.DEFAULT_EMOJI))


def icon_background(icon_bg, slug, colours=V.SLUG_COLOURS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(filled(icon_bg), F.try_element_at(table, as_col(slug)))


def description_lines(description, description_am) -> Column:
    """Non-empty descriptions, English first, each with its language tag."""
    def line(text, lang):
        return F.when(filled(text).isNotNull(), F.struct(as_col(text).alias("text"), F.lit(lang).alias("lang")))

    return F.array_compact(F.array(line(description, ""), line(description_am, "am")))


def display_name(name, name_am) -> Column:
    return F.concat_ws(" ", as_col(name), filled(name_am))


def emoji_label(emoji, name, default: str = V.DEFAULT_EMOJI) -> Column:
    return F.concat(F.coalesce(filled(emoji), F.lit(default)), F.lit(" "), as_col(name))


def header_fields(default_name: str = "", name="name", name_am="name_am", tagline="tagline",
                  address="address", phone="phone", phone_label="phone_label",
                  emoji="header_emoji", footer="footer_text") -> Column:
    """Header texts of an info row; a field with nothing to show is ''."""
    def shown(text):
        return F.coalesce(text, F.lit(""))

    title_am = F.concat(F.lit(" | "), filled(name_am), F.lit(V.TITLE_SUFFIX_AM))
    return F.struct(
        F.concat_ws(" ", filled(emoji), F.coalesce(filled(name), F.lit(default_name))).alias("heading"),
        F.concat_ws(V.SEPARATOR, filled(name_am), filled(tagline)).alias("tagline"),
        shown(F.concat(F.lit(V.ADDRESS_PIN), filled(address))).alias("address"),
        F.when(filled(phone).isNotNull(), phone_uri(phone)).alias("phone_href"),
        F.when(filled(phone).isNotNull(),
               F.concat(F.lit(V.PHONE_PIN), F.coalesce(filled(phone_label), as_col(phone)))).alias("phone_text"),
        shown(filled(footer)).alias("footer"),
        F.concat(filled(name), F.lit(V.TITLE_SUFFIX), shown(title_am)).alias("page_title"),
    )
