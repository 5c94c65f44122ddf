"""Text queries: lines, headers, blocks, fields, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as C
from ..sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def doc_lines(spark, d):
    return C.lines(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


LINES = "l AS (SELECT doc_id, CAST(n - 1 AS BIGINT) AS n, line FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"


@register("clean_lines", f"WITH {LINES} SELECT doc_id, n, trim(regexp_replace(replace(line, chr(160), ' '), '[ \\t]+', ' ', 'g'), ' ') AS line FROM l")
def clean_lines(spark, d):
    return doc_lines(spark, d).select("doc_id", "n", X.cleaned(F.col("line")).alias("line"))


@register(
    "carry_header",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 12) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""",
)
def carry_header(spark, d):
    c = table(spark, d, "conversations")
    header = F.when(F.col("role") == "user", F.substring("text", 1, 12))
    return C.carried(c, "conv_id", "turn", header, "header").select("conv_id", "turn", "header")


@register(
    "segment_blocks",
    f"""WITH {LINES}, b AS (SELECT doc_id, n, line, sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l)
    SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS lines, min(n) AS first FROM b WHERE block > 0 GROUP BY doc_id, block""",
)
def segment_blocks(spark, d):
    b = C.blocks(doc_lines(spark, d), "doc_id", "n", F.regexp_like("line", F.lit("^[A-D]")))
    return b.filter("block > 0").groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("first"))


@register("unhyphenate", "SELECT conv_id, turn, replace(replace(text, 'on ', '-' || chr(10)), '-' || chr(10), '') AS text FROM conversations")
def unhyphenate(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.unhyphenated(F.replace("text", F.lit("on "), F.lit("-\n"))).alias("text"))


DIRECTIONS = {"N": "north", "S": "south", "E": "ast", "W": "wh", "NE": "nd", "C": "ter"}


def _earliest(text: str) -> str:
    hits = " UNION ALL ".join(f"SELECT strpos({text}, '{p}') AS pos, -{len(k)} AS n, '{k}' AS label" for k, p in DIRECTIONS.items())
    return f"(SELECT arg_min(label, (pos, n, label)) FROM ({hits}) WHERE pos > 0)"


@register("first_direction", f"SELECT doc_id, {_earliest('text')} AS direction FROM documents")
def first_direction(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", X.first_match(F.col("text"), DIRECTIONS).alias("direction"))


@register(
    "position_cascade",
    "SELECT doc_id, CASE WHEN regexp_matches(text, 'thth[a-z]*st') THEN 'beyond' WHEN regexp_matches(text, 'edge|outou') THEN 'outskirts' WHEN regexp_matches(text, 'inin') THEN 'inside' ELSE CASE WHEN lang = 'en' THEN 'beyond' ELSE 'near' END END AS position FROM documents",
)
def position_cascade(spark, d):
    t = table(spark, d, "documents", ["doc_id", "text", "lang"])
    cases = [("beyond", "thth[a-z]*st"), ("outskirts", "edge|outou"), ("inside", "inin")]
    return t.select("doc_id", X.cascade(F.col("text"), cases, F.when(F.col("lang") == "en", "beyond").otherwise("near")).alias("position"))


@register("compass_of", "SELECT doc_id, (CASE WHEN contains(text, 'sh') THEN 'N' WHEN contains(text, 'ou') THEN 'S' ELSE '' END) || (CASE WHEN contains(text, 'nd') THEN 'E' WHEN contains(text, 'ie') THEN 'W' ELSE '' END) AS compass FROM documents")
def compass_of(spark, d):
    t = F.col("text")
    ns = F.when(F.contains(t, F.lit("sh")), "N").when(F.contains(t, F.lit("ou")), "S").otherwise("")
    ew = F.when(F.contains(t, F.lit("nd")), "E").when(F.contains(t, F.lit("ie")), "W").otherwise("")
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.concat(ns, ew).alias("compass"))


@register(
    "entry_fields",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, regexp_extract(url, 'page=([0-9]+)', 1) AS page,
    CASE WHEN regexp_extract(url, '/([0-9]+)', 1) <> '' THEN CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) END AS number, regexp_extract(url, '^https?://([^/?]*)', 1) AS host FROM pages""",
)
def entry_fields(spark, d):
    p = table(spark, d, "pages", ["page_id", "url", "html"])
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    return p.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"),
        F.when(number != "", number.cast("long")).alias("number"), F.regexp_extract("url", "^https?://([^/?]*)", 1).alias("host"),
    )


KEYWORDS = {"lf_plateau": "hash", "lf_slope": "ntl", "lf_terrace": "thti", "w_river": "Ther", "w_pond": "edon"}


@register("keyword_flags", "SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(text, '{p}') AS INTEGER) AS {k}" for k, p in KEYWORDS.items()) + " FROM documents")
def keyword_flags(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", *X.flags(F.col("text"), KEYWORDS))


@register(
    "distance_km",
    r"""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'lies ' || CAST(o_custkey % 50 AS VARCHAR) || ',' || CAST(o_orderkey % 10 AS VARCHAR) || ' km from' WHEN 1 THEN CAST(o_custkey AS VARCHAR) || ' m off' ELSE 'near' END AS s FROM orders),
    e AS (SELECT id, regexp_extract(s, '([0-9]+(?:[.,][0-9]+)?) km', 1) AS km, regexp_extract(s, '([0-9]+) m(?:[^a-z]|$)', 1) AS m FROM t)
    SELECT id, round(CASE WHEN km <> '' THEN CAST(replace(km, ',', '.') AS DOUBLE) WHEN m <> '' THEN CAST(m AS DOUBLE) / 1000 END, 3) AS km FROM e""",
)
def distance_km(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("lies "), (c % 50).cast("string"), F.lit(","), (k % 10).cast("string"), F.lit(" km from"))).when(k % 3 == 1, F.concat(c.cast("string"), F.lit(" m off"))).otherwise("near")
    return table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(k.alias("id"), X.kilometres(s).alias("km"))


@register(
    "second_ref",
    r"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'between ' || split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2) ELSE 'south of ' || split_part(p_name, ' ', 2) END AS s FROM part)
    SELECT id, nullif(regexp_extract(s, 'between ([a-z]+) and ([a-z]+)', 2), '') AS between_b, nullif(regexp_extract(s, '(north|south) of ([a-z]+)', 2), '') AS ref2 FROM t""",
)
def second_ref(spark, d):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    s = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("between "), a, F.lit(" and "), b)).otherwise(F.concat(F.lit("south of "), b))
    p = table(spark, d, "part", ["p_partkey", "p_name", "p_size"])
    return p.select(F.col("p_partkey").alias("id"), F.nullif(F.regexp_extract(s, "between ([a-z]+) and ([a-z]+)", 2), F.lit("")).alias("between_b"), F.nullif(F.regexp_extract(s, "(north|south) of ([a-z]+)", 2), F.lit("")).alias("ref2"))


@register("strip_caption", None)
def strip_caption(spark, d):
    """Look-around isn't in RE2, so there is no SQL; a unit test has the cases."""
    t = F.concat(F.substring("text", 1, 20), F.lit(" Fig. 3. "), F.lit("x"), F.expr("substring(text, 21)"))
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", X.without_caption(t).alias("text"))


@register("norm_names", "SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || '  ' || p_type), 'i', 'і'), ' +', ' ', 'g'), ' ') AS key FROM part")
def norm_names(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_name", "p_type"]).select("p_partkey", X.name_key(F.concat("p_name", F.lit("  "), "p_type")).alias("key"))


@register("title_district", "SELECT n_nationkey, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) || '-' || upper(substr(lower(r_name), 1, 1)) || substr(lower(r_name), 2) || ' district' AS title FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE '% %'")
def title_district(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name NOT LIKE '% %'")
    return n.select("n_nationkey", X.titled(F.concat("n_name", F.lit("-"), "r_name")).alias("title"))


@register("name_index", "SELECT DISTINCT key, p_partkey AS place FROM (SELECT unnest(string_split(p_name || ';' || p_type, ';')) AS key, p_partkey FROM part)")
def name_index(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_name", "p_type"]).select(F.explode(F.split(F.concat("p_name", F.lit(";"), "p_type"), ";")).alias("key"), F.col("p_partkey").alias("place")).distinct()


@register(
    "resolve_cascade",
    """WITH e AS (SELECT o_orderkey AS entry, (SELECT min(p_name) FROM part) AS x, o_custkey FROM orders WHERE o_orderkey % 10 = 0), names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)),
    q AS (SELECT e.entry, e.o_custkey, names.p_name FROM e JOIN names ON names.i = e.o_custkey % (names.n + 3)),
    c0 AS (SELECT q.entry, p_partkey AS place, p_type = 'PROMO' AS a, p_brand = 'Brand#' || CAST(q.o_custkey % 25 + 1 AS VARCHAR) AS b, p_size < 10 AS s FROM q JOIN part USING (p_name)),
    c1 AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n0, bool_or(a) OVER (PARTITION BY entry) AS any_a FROM c0),
    c2 AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n1, bool_or(b) OVER (PARTITION BY entry) AS any_b FROM c1 WHERE n0 = 1 OR a OR NOT any_a),
    c3 AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n2, bool_or(s) OVER (PARTITION BY entry) AS any_s FROM c2 WHERE n1 = 1 OR b OR NOT any_b),
    c4 AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n3 FROM c3 WHERE n2 = 1 OR s OR NOT any_s),
    f AS (SELECT entry, min(place) AS place, any_value(CASE WHEN n0 = 1 THEN 'unique' WHEN n1 = 1 THEN 'raion' WHEN n2 = 1 THEN 'koatuu' WHEN n3 = 1 THEN 'kind' ELSE 'ambiguous' END) AS how FROM c4 GROUP BY entry)
    SELECT e.entry, f.place, coalesce(f.how, 'not_found') AS how FROM e LEFT JOIN f USING (entry)""",
)
def resolve_cascade(spark, d):
    """Entries by name among parts of the same name, narrowed step by step. Parts that no
    step tells apart are one row, and entries that ask the same are answered once."""
    from pyspark.sql import Window

    e = table(spark, d, "orders", ["o_orderkey", "o_custkey"]).filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("entry"), "o_custkey")
    p = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size"])
    names = p.select("p_name").distinct().withColumn("i", (F.row_number().over(Window.orderBy("p_name")) - 1).cast("long"))
    n = names.count()
    alike = p.groupBy("p_name", (F.col("p_type") == "PROMO").alias("a"), "p_brand", (F.col("p_size") < 10).alias("s")).agg(F.min("p_partkey").alias("place"), F.count(F.lit(1)).alias("n"))
    e = e.select("entry", (F.col("o_custkey") % (n + 3)).alias("i"), (F.col("o_custkey") % 25 + 1).alias("brand"))
    asked = e.select("i", "brand").distinct().withColumn("entry", F.struct("i", "brand"))
    c = asked.join(names, "i").join(alike, "p_name").select("entry", "place", "n", "a", (F.col("p_brand") == F.concat(F.lit("Brand#"), F.col("brand").cast("string"))).alias("b"), "s")
    found = C.resolve(asked, c, [("raion", F.col("a")), ("koatuu", F.col("b")), ("kind", F.col("s"))], "n")
    found = found.select("entry.i", "entry.brand", "place", "how")
    return e.join(found, ["i", "brand"], "left").select("entry", "place", F.coalesce("how", F.lit("not_found")).alias("how"))


@register("coin_names", "SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]+) the', 1)) AS name FROM documents")
def coin_names(spark, d):
    t = table(spark, d, "documents", ["text"])
    return t.select(F.explode(F.regexp_extract_all("text", F.lit("(?m)^([A-Z][a-z]+) the"), 1)).alias("name")).distinct()


@register("confluence_flag", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'tion (of|and) th')")
def confluence_flag(spark, d):
    return table(spark, d, "documents", ["doc_id", "text"]).filter(F.regexp_like("text", F.lit("tion (of|and) th"))).select("doc_id")


@register("river_candidates", "SELECT doc_id, trim(string_split(string_split(substr(text, 1, 200), '.')[1], ',')[1]) AS river FROM documents")
def river_candidates(spark, d):
    first = F.get(F.split(F.get(F.split(F.substring("text", 1, 200), "[.]"), F.lit(0)), ","), F.lit(0))
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.trim(first).alias("river"))


@register("html_escape", "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') AS url FROM pages")
def html_escape(spark, d):
    u = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return table(spark, d, "pages", ["page_id", "url"]).select("page_id", u.alias("url"))


@register("code_substring", "SELECT p_partkey, substr(p_type, 3, 3) AS code FROM part")
def code_substring(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_type"]).select("p_partkey", F.substring("p_type", 3, 3).alias("code"))
