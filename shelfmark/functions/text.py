"""Text rules: trimming, numbers typed by hand, slugs, escaping, pattern scans."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as V


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def filled(value) -> Column:
    """The text, or null where it is null or empty."""
    return F.nullif(as_col(value), F.lit(""))


def trim_text(value) -> Column:
    return F.btrim(as_col(value), F.lit(V.JS_SPACE_CHARS))


def blank_to_null(value, default: str | None = None) -> Column:
    text = filled(trim_text(value))
    return text if default is None else F.coalesce(text, F.lit(default))


def parse_float(value) -> Column:
    """Leading number of a text as double, 0 where there is none."""
    prefix = rf"\A{V.JS_SPACE}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    number = F.regexp_extract(as_col(value), prefix, 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def parse_int(value) -> Column:
    """Leading whole number of a text as bigint, 0 where there is none; too large is an error."""
    number = filled(F.regexp_extract(as_col(value), rf"\A{V.JS_SPACE}*([+-]?[0-9]+)", 1))
    return F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))


def slugify(value) -> Column:
    dashed = F.regexp_replace(trim_text(F.lower(as_col(value))), r"[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def slug_valid(value) -> Column:
    return F.coalesce(F.lower(trim_text(value)).rlike(V.SLUG_PATTERN), F.lit(False))


def html_escape(value) -> Column:
    """Entities are replaced with '&' first, so that no entity is escaped twice."""
    text = F.coalesce(as_col(value).cast("string"), F.lit(""))
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), V.HTML_ENTITIES, text)


def phone_uri(phone) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(as_col(phone), rf"{V.JS_SPACE}+", ""))


def classify_message(message, rules=V.WRITE_MESSAGE_RULES) -> Column:
    """Label of the first rule whose patterns all match, else the message itself."""
    message = as_col(message)
    for label, patterns in reversed(rules):
        hit = reduce(lambda a, b: a & b, [message.rlike(p) for p in patterns])
        result = F.when(hit, F.lit(label)).otherwise(
            message if label == rules[-1][0] else result)
    return result


def strip_patterns(value, patterns) -> Column:
    return reduce(lambda text, p: F.regexp_replace(text, p, ""), patterns, as_col(value))


def strip_tags(html, patterns=(V.SCRIPT_BLOCKS,)) -> Column:
    return strip_patterns(html, patterns)


def strip_comments(source) -> Column:
    """Block comments go first, then the rest of each line after '//'; most texts have neither."""
    source = as_col(source)
    marked = F.contains(source, F.lit("/*")) | F.contains(source, F.lit("//"))
    return F.when(marked, strip_patterns(source, (V.BLOCK_COMMENTS, V.LINE_COMMENTS))).otherwise(source)


def secret_hits(source, code, rules=V.SECRET_RULES) -> Column:
    """Names of the secret rules a text breaks, in rule order; `code` is the text without comments."""
    source, code = as_col(source), as_col(code)
    tests = [F.when((code if bare else source).rlike(p), F.lit(name)) for name, p, bare in rules]
    return F.array_compact(F.array(*tests))


def near_match(value, first: str, second: str, within: int = 300) -> Column:
    """Does pattern `second` follow pattern `first` with at most `within` characters between?"""
    return as_col(value).rlike(rf"(?:{first})[\s\S]{{0,{within}}}(?:{second})")


def count_label(n, singular: str, plural: str) -> Column:
    n = as_col(n)
    word = F.when(n == 1, F.lit(singular)).otherwise(F.lit(plural))
    return F.concat(n.cast("string"), F.lit(" "), word)
