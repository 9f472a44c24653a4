"""Scalar rules applied to whole tables and whole texts."""

from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions import labels as L
from shelfmark.functions import objects as O
from shelfmark.functions import text as X
from shelfmark.operators.scans import secret_scan
from shelfmark.plans.registry import query

SPACE = V.JS_SPACE


def trim_sql(text):
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def slug_sql(text):
    return rf"regexp_replace(regexp_replace({trim_sql(f'lower({text})')}, '[^a-z0-9]+', '-', 'g'), '\A-+|-+\z', '', 'g')"


PATH_SQL = r"regexp_replace(url, '[?#].*\z', '')"
MEDIA_SQL = "case regexp_extract(lower({0}), '[^/](\\.[^./]*)\\z', 1) " + " ".join(
    f"when '{ext}' then '{media}'" for ext, media in V.MEDIA_TYPES.items()) + f" else '{V.DEFAULT_MEDIA_TYPE}' end"
EXT_SQL = "regexp_replace(lower(coalesce(nullif(split_part({0}, '.', -1), ''), 'jpg')), '[^a-z0-9]', '', 'g')"
TOKEN_RULE = ("token_assigned", r"(?i)token\s*[:=]", True)


# -- labels ----------------------------------------------------------------------------------------

@query("format_price", """
select id, case when price = floor(price) then cast(cast(price as bigint) as varchar)
                else cast(price as varchar) end || ' ' || description price_label from parts""")
def _(s):
    return s.parts().select("id", L.format_price("price", "description").alias("price_label"))


@query("format_price_raw", "select id, rtrim(rtrim(cast(price as varchar), '0'), '.') || ' ETB' price_label from parts")
def _(s):
    return s.parts().select("id", L.format_price_raw("price").alias("price_label"))


@query("display_badge", """
select id, case when not is_available then 'SOLD OUT' when badge = 'new' then 'NEW'
                when badge = 'hot' then 'HOT' else '' end badge_label from it""")
def _(s):
    return s.items().select("id", L.display_badge("is_available", "badge").alias("badge_label"))


@query("status_pills", """
select id, concat_ws(' ', case badge when 'new' then 'NEW' end, case badge when 'hot' then 'HOT' end,
                     case when not is_available then 'SOLD OUT' end) pills from it""")
def _(s):
    return s.items().select("id", F.concat_ws(" ", L.status_pills("is_available", "badge")).alias("pills"))


def icon_parts(s):
    segment = F.col("c_mktsegment")
    return s.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(segment == "FURNITURE", F.concat(F.lit("https://img/"), F.col("c_custkey")))
         .when(segment == "HOUSEHOLD", F.lit("")).alias("image_url"),
        F.when(segment == "BUILDING", F.lit("🍕")).when(segment == "MACHINERY", F.lit("")).alias("emoji"),
        F.when(F.col("c_nationkey") < 12, F.lit("🥤")).alias("category_emoji"))


@query("display_icon", """
with p as (select c_custkey id,
  case c_mktsegment when 'FURNITURE' then 'https://img/' || c_custkey when 'HOUSEHOLD' then '' end img,
  case c_mktsegment when 'BUILDING' then '🍕' when 'MACHINERY' then '' end e, case when c_nationkey < 12 then '🥤' end c
  from customer)
select id, coalesce(nullif(img, ''), nullif(e, ''), nullif(c, ''), '🍽') icon,
       coalesce(nullif(img, ''), nullif(e, ''), '🍽') owner_icon from p""", views=False)
def _(s):
    return icon_parts(s).select("id", L.display_icon("image_url", "emoji", "category_emoji").alias("icon"),
                                L.display_icon("image_url", "emoji").alias("owner_icon"))


@query("icon_background", """
select c_custkey id, coalesce(nullif(case when c_nationkey < 5 then '' when c_nationkey < 10 then '#f4f1e9' end, ''),
  case c_mktsegment when 'BUILDING' then '#fff3e0' when 'MACHINERY' then '#efebe9' end) background from customer""")
def _(s):
    slug = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("pizza")) \
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("coffee")).otherwise(F.lower("c_mktsegment"))
    own = F.when(F.col("c_nationkey") < 5, F.lit("")).when(F.col("c_nationkey") < 10, F.lit("#f4f1e9"))
    return s.table("customer").select(F.col("c_custkey").alias("id"), L.icon_background(own, slug).alias("background"))


@query("description_lines", """
with d as (select doc_id, case when lang in ('en', 'de') then text else '' end en,
                  case when lang in ('fr', 'de') then text end am from documents)
select doc_id, concat_ws('|', case when en <> '' then ':' || md5(en) end, case when am <> '' then 'am:' || md5(am) end) lines
from d""", views=False)
def _(s):
    docs = s.table("documents").select(
        "doc_id", F.when(F.col("lang").isin("en", "de"), F.col("text")).otherwise(F.lit("")).alias("en"),
        F.when(F.col("lang").isin("fr", "de"), F.col("text")).alias("am"))
    lines = F.transform(L.description_lines("en", "am"), lambda x: F.concat(x["lang"], F.lit(":"), F.md5(x["text"].cast("binary"))))
    return docs.select("doc_id", F.concat_ws("|", lines).alias("lines"))


@query("display_name", """
select id, case when description = 'BUILDING' then name else name || ' ' || description end shown from it""")
def _(s):
    am = F.when(F.col("description") == "BUILDING", F.lit("")).otherwise(F.col("description"))
    return s.items().select("id", L.display_name("name", am).alias("shown"))


@query("header_fields", """
with i as (select s_suppkey id, s_name name, case when s_nationkey < 12 then 'N' || s_nationkey when s_nationkey < 15 then '' end am,
  case when s_acctbal > 0 then 'Good food' end tagline, 'Street ' || s_nationkey address,
  case when s_nationkey < 20 then '+1  555 ' || s_suppkey end phone, case when s_nationkey < 10 then 'call us' else '' end label,
  case when s_nationkey > 3 then '🍽' end emoji, case when s_nationkey > 6 then '© ' || s_name end footer from supplier)
select id, concat_ws(' ', emoji, name) heading, concat_ws(' • ', nullif(am, ''), tagline) tagline, '📍 ' || address address,
  'tel:' || regexp_replace(phone, '\\s+', '', 'g') phone_href, '📞 ' || coalesce(nullif(label, ''), phone) phone_text,
  coalesce(footer, '') footer, name || ' Menu' || coalesce(' | ' || nullif(am, '') || ' ሜኑ', '') page_title from i""", views=False)
def _(s):
    nation = F.col("s_nationkey")
    info = s.table("supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(nation < 12, F.concat(F.lit("N"), nation)).when(nation < 15, F.lit("")).alias("name_am"),
        F.when(F.col("s_acctbal") > 0, F.lit("Good food")).alias("tagline"),
        F.concat(F.lit("Street "), nation).alias("address"),
        F.when(nation < 20, F.concat(F.lit("+1  555 "), F.col("s_suppkey"))).alias("phone"),
        F.when(nation < 10, F.lit("call us")).otherwise(F.lit("")).alias("phone_label"),
        F.when(nation > 3, F.lit("🍽")).alias("header_emoji"),
        F.when(nation > 6, F.concat(F.lit("© "), F.col("s_name"))).alias("footer_text"))
    return info.select("id", L.header_fields().alias("h")).select("id", "h.*")


@query("count_label", """
select user_id, count(*) || case count(*) when 1 then ' category' else ' categories' end label from events group by user_id""")
def _(s):
    counts = s.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", X.count_label("n", "category", "categories").alias("label"))


# -- text ------------------------------------------------------------------------------------------

@query("phone_uri", """
select id, 'tel:' || '+251' || id || cast(price as varchar) uri from it""")
def _(s):
    phone = F.concat(F.lit("+251 "), F.col("id").cast("string"), F.lit("\t "), F.col("price").cast("string"), F.lit(" \n"))
    return s.items().select("id", X.phone_uri(phone).alias("uri"))


@query("slugify", f"select doc_id, md5({slug_sql('text')}) slug from documents", views=False)
def _(s):
    return s.table("documents").select("doc_id", F.md5(X.slugify("text").cast("binary")).alias("slug"))


@query("slug_valid", r"""
select p_partkey, regexp_matches(lower(replace(p_name, ' ', case when p_size > 25 then '-' else ' ' end)), '\A[a-z0-9-]+\z') ok
from part""")
def _(s):
    joint = F.when(F.col("p_size") > 25, F.lit("-")).otherwise(F.lit(" "))
    slug = F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), joint)), F.lit("\t"))
    return s.table("part").select("p_partkey", X.slug_valid(slug).alias("ok"))


@query("blank_to_null", """
select doc_id, case when lang = 'fr' then null else md5(""" + trim_sql("text") + """) end trimmed,
       case when lang = 'fr' then 'ETB' else lang end or_default from documents""", views=False)
def _(s):
    pad = F.lit("  \t\n　")
    typed = F.when(F.col("lang") == "fr", pad).otherwise(F.concat(pad, "text", pad))
    short = F.when(F.col("lang") == "fr", pad).otherwise(F.concat(pad, "lang"))
    return s.table("documents").select("doc_id", F.md5(X.blank_to_null(typed).cast("binary")).alias("trimmed"),
                                       X.blank_to_null(short, V.DEFAULT_CURRENCY).alias("or_default"))


@query("coerce_number", """
select event_id, case event_type when 'view' then 0.0 when 'click' then cast(user_id as double) * 100
                      else cast(cast(value as varchar) as double) end price,
       case event_type when 'view' then 0 when 'error' then -user_id else user_id end sort_order from events""")
def _(s):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    price = F.when(kind == "view", F.concat(kind, user)).when(kind == "click", F.concat(user, F.lit("e2x"))) \
        .otherwise(F.concat(F.lit(" \t"), F.col("value").cast("string"), kind))
    order = F.when(kind == "view", F.lit("x1")).when(kind == "error", F.concat(F.lit(" -"), user, F.lit(".9"))) \
        .otherwise(F.concat(F.lit("+"), user, kind))
    return s.table("events").select("event_id", X.parse_float(price).alias("price"), X.parse_int(order).alias("sort_order"))


@query("html_escape", """
select page_id, length(e) n_chars, md5(e) digest from (select page_id, replace(replace(replace(replace(replace(
  html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') e from pages)""", views=False)
def _(s):
    escaped = s.table("pages").select("page_id", X.html_escape("html").alias("e"))
    return escaped.select("page_id", F.length("e").cast("bigint").alias("n_chars"), F.md5(F.col("e").cast("binary")).alias("digest"))


def messages(s):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    text = F.when(kind == "error", F.concat(F.lit("duplicate KEY value in "), F.when(F.col("value") > 10, F.lit("slug ")).otherwise(F.lit("id ")), user)) \
        .when(kind == "signup", F.concat(F.lit("new row violates Row-Level Security for "), user)) \
        .when(kind == "view", F.lit("TypeError: failed to fetch")) \
        .when(kind == "click", F.concat(F.lit("Email not confirmed, duplicate key slug "), user)) \
        .otherwise(F.concat(F.lit("other "), user))
    return s.table("events").select("event_id", text.alias("message"))


@query("classify_message", """
select event_id, case event_type when 'error' then case when value > 10 then 'duplicate_slug' else 'duplicate KEY value in id ' || user_id end
  when 'signup' then 'denied' when 'view' then 'network' when 'click' then 'unconfirmed' else 'other ' || user_id end kind,
  case when event_type in ('error', 'signup', 'view', 'click', 'purchase') then doc end doc_kind
from events left join (select doc_id, case when regexp_matches(text, '(?i)password') and regexp_matches(text, '(?i)@') then 'login'
  when regexp_matches(text, '(?i)token') then 'token' else 'none' end doc from documents) on doc_id = event_id""")
def _(s):
    kinds = messages(s).select("event_id", X.classify_message("message").alias("kind"))
    rules = [("login", ["(?i)password", "(?i)@"]), ("token", ["(?i)token"]), ("none", [r"(?s)\A.*\z"])]
    docs = s.table("documents").select(F.col("doc_id").alias("event_id"), X.classify_message("text", rules).alias("doc_kind"))
    return kinds.join(docs, "event_id", "left")


PROBES = """select event_id, case when event_type = 'error' then 'relation "t' || user_id || '" does not exist'
  when event_type = 'view' then 'invalid api KEY ' || user_id when event_type = 'click' then 'bad jwt'
  else 'all well ' || user_id end m from events"""


@query("classify_probe", f"""
select event_id, case when regexp_matches(m, '(?i)relation .* does not exist|schema cache') then 'tables_missing'
  when regexp_matches(m, '(?i)Invalid API key|JWT') then 'key_rejected' else m end kind from ({PROBES})""", views=False)
def _(s):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    message = F.when(kind == "error", F.concat(F.lit('relation "t'), user, F.lit('" does not exist'))) \
        .when(kind == "view", F.concat(F.lit("invalid api KEY "), user)).when(kind == "click", F.lit("bad jwt")) \
        .otherwise(F.concat(F.lit("all well "), user))
    return s.table("events").select("event_id", X.classify_message(message, V.PROBE_MESSAGE_RULES).alias("kind"))


@query("strip_tags", r"""
select page_id, length(t) n_chars, md5(t) digest, length(u) n_offline, md5(u) offline_digest from
  (select page_id, regexp_replace(html, '<script[^>]*>[\s\S]*?</script>', '', 'g') t,
          regexp_replace(regexp_replace(h, '<script[^>]*src=[^>]*></script>', '', 'g'), '<link[^>]*href="https://fonts[^>]*>', '', 'g') u
   from (select *, '<link rel="x" href="https://fonts.example/a.css"><script async src="a.js"></script>' || html h from pages))""", views=False)
def _(s):
    """Pages without scripts, and pages with an external script and a font put in, without those."""
    added = F.concat(F.lit('<link rel="x" href="https://fonts.example/a.css"><script async src="a.js"></script>'), F.col("html"))
    bare = s.table("pages").select("page_id", X.strip_tags("html").alias("t"),
                                   X.strip_tags(added, (V.EXTERNAL_SCRIPTS, V.FONT_LINKS)).alias("u"))
    return bare.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"),
                       F.length("u").cast("bigint").alias("n_offline"), F.md5(F.col("u").cast("binary")).alias("offline_digest"))


ASSIGNED = r"(?i)service_role[\"'']?\s*[:=]|SERVICE_ROLE_KEY\s*[:=]"


@query("secret_scan", rf"""
with d as (select doc_id id, text from documents union all select page_id + 1000000000 id, html text from pages
           union all select event_id + 2000000000, 'see http://x.example/ service_role = "' || user_id || '"' from events where event_type = 'error'
           union all select event_id + 2000000000, 'service_role: ' || user_id from events where event_type = 'view'),
c as (select id, text, regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '{V.LINE_COMMENTS}', '', 'g') code from d)
select id, 'token_assigned' rule from c where regexp_matches(code, '(?i)token\s*[:=]')
union all select id, 'service_key_word' from c where regexp_matches(code, '(?i)service_role|SUPABASE_SERVICE')
union all select id, 'service_key_assigned' from c where regexp_matches(code, '{ASSIGNED}')
union all select id, 'service_key_assigned_raw' from c where regexp_matches(text, '{ASSIGNED}')
union all select id, 'signed_token_header' from c where regexp_matches(text, 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9')""", views=False)
def _(s):
    """Documents, pages, and lines made of events: a key behind an address, which only the raw rule sees, and a plain one."""
    docs = s.table("documents").select(F.col("doc_id").alias("id"), "text")
    pages = s.table("pages").select((F.col("page_id") + 1000000000).alias("id"), F.col("html").alias("text"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('see http://x.example/ service_role = "'), "user_id", F.lit('"'))) \
        .when(F.col("event_type") == "view", F.concat(F.lit("service_role: "), "user_id"))
    lines = s.table("events").select((F.col("event_id") + 2000000000).alias("id"), line.alias("text")).where("text is not null")
    return secret_scan(docs.unionByName(pages).unionByName(lines), "text", "id", [*V.SECRET_RULES, TOKEN_RULE])


@query("near_match", r"""
select doc_id, regexp_matches(text, '(?:(?i)token)[\s\S]{0,300}(?:[0-9a-f]{40})') token_near_key,
       regexp_matches(text, '(?:\. Th)[\s\S]{0,300}(?:[?]|the o)') near_word from documents""", views=False)
def _(s):
    return s.table("documents").select(
        "doc_id", X.near_match("text", "(?i)token", "[0-9a-f]{40}").alias("token_near_key"),
        X.near_match("text", r"\. Th", r"[?]|the o").alias("near_word"))


# -- objects, addresses, tokens --------------------------------------------------------------------

@query("object_ext", "select page_id, " + EXT_SQL.format("url") + " ext from pages", views=False)
def _(s):
    return s.table("pages").select("page_id", O.object_ext("url").alias("ext"))


@query("object_key", """
select page_id, 'items/' || (1700000000000 + page_id) || '-' || substr(md5(cast(page_id as varchar)), 1, 6) || '.' || """
       + EXT_SQL.format("url") + " key from pages", views=False)
def _(s):
    saved = F.lit(1700000000000) + F.col("page_id")
    return s.table("pages").select("page_id", O.object_key("url", saved, "page_id").alias("key"))


@query("object_key_from_url", """
select page_id, case when contains(url, '/en/') then split_part(substr(url, instr(url, '/en/') + 4), '?', 1) end key from pages""", views=False)
def _(s):
    return s.table("pages").select("page_id", O.object_key_from_url("url", "en").alias("key"))


@query("upload_valid", """
select doc_id, case when n_chars * 1000 > 2097152 then 'too_large' when lang in ('fr', 'de') then 'not_image' else 'ok' end outcome
from documents""", views=False)
def _(s):
    media = F.when(F.col("lang") == "en", F.lit("image/png")).when(F.col("lang") == "fr", F.lit("text/image/")) \
        .when(F.col("lang") == "es", F.lit("image/"))
    return s.table("documents").select("doc_id", O.upload_valid(F.col("n_chars") * 1000, media).alias("outcome"))


@query("media_type", f"select page_id, {MEDIA_SQL.format(PATH_SQL)} media from pages", views=False)
def _(s):
    path = F.regexp_replace("url", r"[?#].*\z", "")
    return s.table("pages").select("page_id", O.media_type(path).alias("media"))


@query("url_checks", r"""
select page_id, regexp_replace(url, '/+\z', '') base,
       regexp_matches(regexp_replace(url, '/+\z', ''), '(?i)\A(?:https://[a-z0-9.-]+\.example\.(com|org)/EN/[0-9]+)\z') ok
from pages""", views=False)
def _(s):
    pattern = r"https://[a-z0-9.-]+\.example\.(com|org)/EN/[0-9]+"
    return s.table("pages").select("page_id", O.url_base("url").alias("base"), O.url_matches("url", pattern).alias("ok"))


@query("token_role", """
select conv_id, turn, case role when 'assistant' then 'service_role' when 'user' then 'anon' end claimed,
       case role when 'assistant' then 'forbidden' when 'user' then 'ok' else 'unknown' end verdict from conversations""", views=False)
def _(s):
    role = F.col("role")
    claim = F.when(role == "assistant", F.lit("service_role")).when(role == "user", F.lit("anon"))
    body = F.concat(F.lit('{"role":"'), claim, F.lit('","t":"'), F.translate("text", '"\\\n', "'' "), F.lit('"}'))
    coded = F.translate(F.base64(body.cast("binary")), "+/=\r\n", "-_")
    token = F.concat(F.lit("e30."), F.coalesce(coded, F.lit("!not base64!")), F.lit(".sig"))
    return s.table("conversations").select("conv_id", "turn", O.token_role(token).alias("claimed"), O.token_class(token).alias("verdict"))
