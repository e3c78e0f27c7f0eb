"""Queries for the core operators over the tables of a data folder, with SQL of the same meaning.

Inputs that no table has (raw source strings, pages, caption files) are derived from tables by
SQL text that Spark and the other engine read alike.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from html import escape as html_escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import urls
from quillmesh.functions.text import trimmed
from quillmesh.operators import captions, detect, files, html, identity, sinks, social, tables, textops
from quillmesh.runtime import once, table
from quillmesh.sources import linked_texts

SOURCES = """
    SELECT doc_id, CASE doc_id % 20
        WHEN 0 THEN 'https://' || source || '.example/files/report-' || CAST(doc_id AS STRING) || '.pdf'
        WHEN 1 THEN '/data/' || source || '/Note ' || CAST(doc_id AS STRING) || '.PDF'
        WHEN 2 THEN 'https://' || source || '.example/d/Plan_' || CAST(doc_id AS STRING) || '.docx?v=2'
        WHEN 3 THEN 'C/' || source || '/sheet' || CAST(doc_id AS STRING) || '.xlsx'
        WHEN 4 THEN 'https://' || source || '.example/s/' || CAST(doc_id AS STRING) || '.pptx#page'
        WHEN 5 THEN 'book-' || CAST(doc_id AS STRING) || '.epub'
        WHEN 6 THEN 'https://img.example/' || source || '/' || CAST(doc_id AS STRING) || '.JPG'
        WHEN 7 THEN 'scan_' || CAST(doc_id AS STRING) || '.tiff'
        WHEN 8 THEN 'readme-' || CAST(doc_id AS STRING) || '.md'
        WHEN 9 THEN 'notes/' || source || '.TXT'
        WHEN 10 THEN 'https://www.youtube.com/watch?list=a&v=abcdefgh' || CAST(100 + doc_id % 900 AS STRING)
        WHEN 11 THEN 'https://youtu.be/abcdefgh' || CAST(100 + doc_id % 900 AS STRING) || '?t=3'
        WHEN 12 THEN 'https://www.youtube.com/playlist?list=x' || CAST(doc_id AS STRING)
        WHEN 13 THEN 'https://m.youtube.com/shorts/abcdefgh' || CAST(100 + doc_id % 900 AS STRING)
        WHEN 14 THEN 'https://x.com/user_' || CAST(doc_id AS STRING) || '/status/' || CAST(doc_id * 7 AS STRING)
        WHEN 15 THEN 'https://' || source || '.example/'
        WHEN 16 THEN 'HTTPS://WWW.' || source || '.EXAMPLE/Deep/Path-' || CAST(doc_id AS STRING) || '/?q=a.pdf'
        WHEN 17 THEN 'https://github.com/' || source || '/repo' || CAST(doc_id AS STRING)
        WHEN 18 THEN 'no scheme ' || CAST(doc_id AS STRING)
        ELSE 'https://' || source || '.example/data/' || CAST(doc_id AS STRING) || '.csv' END AS raw
    FROM documents"""

PAGES = """
    SELECT doc_id, 'https://' || source || '.example/a/b/' || CAST(doc_id AS STRING) AS url,
        '<html><head><title>  Page &amp; ' || CAST(doc_id AS STRING) || '  </title><style>p {}</style></head><body><nav><a href="/n">Nav</a></nav>'
        || CASE WHEN doc_id % 3 = 0 THEN '<article class="x">' ELSE '<main>' END || '<script>var a = "<p>";</script><!-- note -->'
        || '<h1>Head <i>' || CAST(doc_id AS STRING) || '</i></h1><p>' || replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p><h2> Two </h2>'
        || '<ul><li>One &quot;q&quot; item</li><li><a href="/x/' || CAST(doc_id AS STRING) || '">Link <b>' || CAST(doc_id AS STRING) || '</b></a></li><li><a href="#top">Top</a></li><li><a href="https://e.example/"></a></li></ul>'
        || '<p><strong>Bold </strong> and <em> it</em> with <code>x &lt; y</code></p><pre><code>a &amp;&amp; b</code></pre><hr><blockquote>first' || chr(10) || ' second</blockquote>'
        || '<img alt="pic" src="//cdn.example/p.png"><img src="q.png"><div>end</div></main></article><footer>foot</footer></body></html>' AS html
    FROM documents"""

VTT = """
    SELECT extraction_id, seq, start_ms, end_ms, coalesce(text, '') AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY extraction_id, seq ORDER BY arrived_at) AS nth FROM segments) x WHERE nth = 1"""

STAMP = """lpad(CAST(floor({0} / 3600000) AS STRING), 2, '0') || ':' || lpad(CAST(floor({0} / 60000) % 60 AS STRING), 2, '0') || ':' || lpad(CAST(floor({0} / 1000) % 60 AS STRING), 2, '0') || '.' || lpad(CAST({0} % 1000 AS STRING), 3, '0')"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WS = r"[ \t\n\r\f\x0B\x{00A0}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def first_sql(x: str) -> str:
    return "[x FOR x IN [" + trim_sql("y") + f" FOR y IN string_split({x}, chr(10))] IF x <> ''][1]"


HTTP = "regexp_matches(raw, '(?i)^https?://')"
HOST = "regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(raw, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A frame from one of the SQL texts above."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(sql)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(derived(spark, sf_dir, SOURCES, "documents"), raw=F.col("raw"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(derived(spark, sf_dir, PAGES, "documents"), url=F.col("url"), html=F.col("html"))


KIND = rf"""CASE WHEN vid IS NOT NULL THEN 'youtube'
    WHEN CASE WHEN http THEN regexp_matches(path, '(?i)\.pdf(\?|$)') ELSE lower(raw) LIKE '%.pdf' END THEN 'pdf'
    WHEN regexp_matches(CASE WHEN http THEN path ELSE raw END, '(?i)\.(docx|xlsx|pptx|epub)(\?|$)') THEN 'docs'
    WHEN NOT http AND regexp_matches(raw, '(?i)\.(md|markdown|txt|text)$') THEN 'text'
    WHEN regexp_matches(CASE WHEN http THEN path ELSE raw END, '(?i)\.(png|jpg|jpeg|gif|webp|bmp|tiff|tif)(\?|$)') THEN 'image'
    WHEN http AND NOT regexp_matches(raw, '(?i)^https?://(www\.)?(youtube\.com|youtu\.be)/') AND NOT regexp_matches(path, '(?i)\.pdf$') THEN 'html' END"""
DETECTED = rf"""WITH s AS ({SOURCES}), p AS (SELECT *, {HTTP} AS http, {PATH} AS path, regexp_replace({HOST}, '^www\.', '') AS host FROM s),
    v AS (SELECT *, nullif(CASE WHEN host = 'youtu.be' THEN regexp_extract(path, '^/([A-Za-z0-9_-]{{11}})(/.*)?$', 1)
        WHEN host IN ('youtube.com', 'm.youtube.com') AND path = '/watch' THEN regexp_extract(raw, '[?&]v=([A-Za-z0-9_-]{{11}})(&|#|$)', 1)
        WHEN host IN ('youtube.com', 'm.youtube.com') THEN regexp_extract(path, '^/(shorts|embed)/([A-Za-z0-9_-]{{11}})(/.*)?$', 2) END, '') AS vid FROM p),
    k AS (SELECT *, {KIND} AS kind FROM v)"""


@query("detect_kind", DETECTED + " SELECT doc_id, kind, NOT http AS is_local, vid AS video_id, CASE WHEN kind IS NULL THEN 30 END AS exit_code FROM k")
def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-DET-1, 3 to 8, 11, 13."""
    return detect.detected(sources(spark, sf_dir)).select("doc_id", "kind", "is_local", "video_id", "exit_code")


@query("detect_ext", DETECTED + r""" SELECT doc_id, lower(nullif(regexp_extract(CASE WHEN http THEN path ELSE raw END, '(?i)\.(docx|xlsx|pptx|epub|png|jpg|jpeg|gif|webp|bmp|tiff|tif)(\?|$)', 1), '')) AS ext,
    regexp_matches(raw, '(?i)^https?://(www\.)?(x|twitter)\.com(/|$)') AS is_thread, regexp_matches(raw, '^https?://(www\.)?(x\.com|twitter\.com)/[^/]+/status/\d+') AS is_post FROM k""")  # fmt: skip
def detect_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-DET-5, 7, 8, 9."""
    d = detect.detected(sources(spark, sf_dir))
    return d.select("doc_id", "ext", "is_thread", detect.is_thread_post(F.col("raw")).alias("is_post"))


@query("forced_provider", DETECTED + " SELECT doc_id, CASE WHEN kind = 'pdf' THEN NULL ELSE 11 END AS exit_code, 2 AS unknown_code FROM k")
def forced_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-DET-10."""
    return sources(spark, sf_dir).select("doc_id", detect.forced(F.col("raw"), "pdf").alias("exit_code"), detect.forced(F.col("raw"), "no such kind").alias("unknown_code"))


@query("probe_type", f"""WITH s AS ({SOURCES}), p AS (SELECT *, {PATH} AS path FROM s), e AS (SELECT *, lower(regexp_extract(path, '(?i)\\.([a-z0-9]+)$', 1)) AS ext0 FROM p)
    SELECT doc_id, CASE WHEN regexp_matches(raw, '(?i)github\\.com/[^/]+/[^/]+') THEN 'repo' WHEN regexp_matches(raw, '(?i)youtube\\.com|youtu\\.be') THEN 'video' WHEN ext0 = 'pdf' THEN 'paper' WHEN ext0 = 'docx' THEN 'doc'
        WHEN ext0 IN ('xlsx', 'csv') THEN 'spreadsheet' WHEN ext0 = 'pptx' THEN 'slides' WHEN ext0 = 'epub' THEN 'book' WHEN ext0 = 'jpg' THEN 'image' ELSE 'webpage' END AS source_type,
        CASE WHEN regexp_matches(raw, '(?i)github\\.com/[^/]+/[^/]+|youtube\\.com|youtu\\.be') THEN NULL WHEN ext0 IN ('pdf', 'docx', 'xlsx', 'csv', 'pptx', 'epub', 'jpg', 'md', 'txt') THEN ext0 ELSE 'html' END AS ext FROM e""")  # fmt: skip
def probe_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SRC-12."""
    p = sources(spark, sf_dir).select("doc_id", detect.probed(F.col("raw")).alias("p"))
    return p.select("doc_id", "p.source_type", "p.ext")


HEADERS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'attachment; filename*=UTF-8' || chr(39) || chr(39) || coalesce(lang, 'x') || '%20' || CAST(doc_id AS STRING) || '+%C3%A9.pdf' WHEN 1 THEN 'attachment; filename="Report ' || CAST(doc_id AS STRING) || '.docx"; size=3'
    WHEN 2 THEN 'inline' ELSE 'attachment; filename= plain' || CAST(doc_id AS STRING) || '.txt ' END AS h FROM documents"""


@query("disposition_name", f"""SELECT doc_id, nullif(url_decode(trim(regexp_extract(h, 'filename\\*?=(?:[^\\x27"]*\\x27\\x27)?"?([^";]+)"?', 1))), '') AS name FROM ({HEADERS})""")
def disposition_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SRC-13."""
    return derived(spark, sf_dir, HEADERS, "documents").select("doc_id", detect.named_in(F.col("h")).alias("name"))


@query("login_wall", """WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' Join LinkedIn' WHEN 1 THEN ' Sign in or Sign up' WHEN 2 THEN ' Log in' ELSE '' END AS t FROM documents)
    SELECT doc_id, contains(t, 'Join LinkedIn') OR (length(t) < 500 AND (contains(t, 'Sign in') OR contains(t, 'Log in')) AND contains(t, 'Sign up')) AS wall FROM t""")  # fmt: skip
def login_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-DET-12."""
    m = F.col("doc_id") % 5
    t = F.concat(F.coalesce("text", F.lit("")), F.when(m == 0, " Join LinkedIn").when(m == 1, " Sign in or Sign up").when(m == 2, " Log in").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", detect.is_login_wall(t).alias("wall"))


SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace({0}, '[ßøØłŁđĐæÆœŒıŧŦħĦŋŊþÞðÐĸŉ]', '', 'g')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def cut_sql(x: str, most: int) -> str:
    """A slug within a limit: cut back to a whole word where it has one."""
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(CASE WHEN regexp_matches(left({x}, {most}), '^.+-') THEN regexp_extract(left({x}, {most}), '^(.+)-[^-]*$', 1) ELSE left({x}, {most}) END, '-+$', '') END"


@query("title_slug", f"""WITH t AS (SELECT DISTINCT title, {SLUG.format('title')} AS s FROM extractions WHERE title IS NOT NULL)
    SELECT title, {cut_sql('s', 80)} AS slug, {cut_sql('s', 24)} AS short_slug FROM t""")  # fmt: skip
def title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-1 on titles; tested against Python's Unicode tables."""
    return table(spark, sf_dir, "extractions").where("title is not null").select("title", identity.slug(F.col("title")).alias("slug"), identity.slug(F.col("title"), 24).alias("short_slug")).distinct()


@query("url_slug", f"""WITH s AS ({SOURCES}), b AS (SELECT doc_id, {SLUG.format('(' + HOST + " || ' ' || " + PATH + ')')} AS s FROM s WHERE {HTTP})
    SELECT doc_id, coalesce(nullif(CASE WHEN length(s) <= 80 THEN s ELSE regexp_replace(s[1:80], '-[^-]*$', '') END, ''), 'page') AS slug FROM b""")  # fmt: skip
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-2."""
    return sources(spark, sf_dir).where(urls.is_http(F.col("raw"))).select("doc_id", identity.url_slug(F.col("raw")).alias("slug"))


NAME_SQL = "regexp_extract(regexp_replace(CASE WHEN http THEN path ELSE raw END, '/+$', ''), '([^/]*)$', 1)"
STEM_SQL = "regexp_replace({0}, '([^.])[.][^.]*$', '\\1')"


@query("input_slug", DETECTED + rf""", n AS (SELECT *, {NAME_SQL} AS name, {HOST} AS authority FROM k WHERE kind IS NOT NULL),
    b AS (SELECT *, CASE kind WHEN 'pdf' THEN regexp_replace(name, '(?i)[.]pdf$', '') WHEN 'docs' THEN regexp_replace(name, '(?i)[.](docx|xlsx|pptx|epub)$', '') ELSE {STEM_SQL.format('name')} END AS bare FROM n),
    w AS (SELECT *, CASE kind WHEN 'html' THEN authority || ' ' || path WHEN 'youtube' THEN vid ELSE CASE WHEN http THEN coalesce(nullif(bare, ''), authority) ELSE {STEM_SQL.format('name')} END END AS words FROM b),
    f AS (SELECT *, {SLUG.format('words')} AS s FROM w)
    SELECT doc_id, kind, coalesce(nullif({cut_sql('s', 80)}, ''), CASE kind WHEN 'docs' THEN 'doc' WHEN 'html' THEN 'page' ELSE kind END) AS slug, left(regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g'), 40) AS work_name FROM f""")  # fmt: skip
def input_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-2b to 2f."""
    d = detect.detected(sources(spark, sf_dir)).where("kind is not null")
    return d.select("doc_id", "kind", identity.input_slug(F.col("raw"), F.col("kind"), F.col("video_id")).alias("slug"), identity.work_name(F.col("raw")).alias("work_name"))


@query("slug_collision", """WITH d AS (SELECT doc_id, coalesce(nullif(source, ''), '') AS slug, coalesce(lang, 'xx') || '-' || CAST(doc_id AS STRING) AS source_id FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id, source_id) AS n FROM d), s AS (SELECT *, row_number() OVER (PARTITION BY slug || '--' || left(source_id, 8), n > 1 ORDER BY doc_id, source_id) AS m FROM r)
    SELECT doc_id, CASE WHEN n = 1 THEN slug WHEN m = 1 THEN slug || '--' || left(source_id, 8) ELSE slug || '--' || source_id END AS final_slug FROM s""")  # fmt: skip
def slug_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-3: every source of documents is one slug that all its rows want."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("slug"), F.concat(F.coalesce("lang", F.lit("xx")), F.lit("-"), F.col("doc_id").cast("string")).alias("source_id"))
    return identity.disambiguated(d, order="doc_id").select("doc_id", "final_slug")


@query("titles", f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## ' WHEN 1 THEN '#' || chr(10) WHEN 2 THEN '| a |' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM documents)
    SELECT doc_id, coalesce(left([x FOR x IN [{trim_sql("regexp_replace(" + trim_sql('y') + ", '^#+[ \\t]*', '')")} FOR y IN string_split(t, chr(10))] IF x <> ''][1], 80), 'none') AS page_title,
        coalesce(nullif({trim_sql("coalesce(left(" + trim_sql("regexp_replace(" + first_sql('t') + ", '^#+', '')") + ", 80), '')")}, ''), 'none') AS has_text_title FROM t""")  # fmt: skip
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-4, 5."""
    m = F.col("doc_id") % 4
    t = F.concat(F.when(m == 0, "## ").when(m == 1, "#\n").when(m == 2, "| a |\n").otherwise(""), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    text = identity.text_title(F.col("t"), F.lit("none"))
    return d.select("doc_id", identity.page_title(F.col("t"), F.lit("none")).alias("page_title"), F.coalesce(F.nullif(trimmed(text), F.lit("")), F.lit("none")).alias("has_text_title"))


@query("html_title", f"SELECT doc_id, {trim_sql(f"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{WS}+', ' ', 'g')")} AS title FROM ({PAGES})")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ID-8."""
    return pages(spark, sf_dir).select("doc_id", identity.html_title(F.col("html")).alias("title"))


REGION = f"WITH p AS ({PAGES}), r AS (SELECT doc_id, url, regexp_extract(html, '(?is)<(?:article|main)[^>]*>(.*?)</(?:article|main)>', 1) AS r FROM p), c AS (SELECT doc_id, url, regexp_replace(regexp_replace(r, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS c FROM r)"


@query("html_region", REGION + " SELECT doc_id, c AS region FROM c")
def html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-HTML-1 to 3."""
    return pages(spark, sf_dir).select("doc_id", html.without_chrome(html.region(F.col("html"))).alias("region"))


def each_sql(text: str, pattern: str, made: str) -> str:
    """Every match m of a pattern in a text replaced by what is made of it."""
    return f"list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '{pattern}'))), lambda acc, m: replace(acc, m, {made}))"


def bare_sql(x: str) -> str:
    return trim_sql(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


def decoded_sql(x: str) -> str:
    for name, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        x = f"replace({x}, '{name}', '{c}')"
    return x


def inside_sql(element: str) -> str:
    return f"regexp_extract(m, '(?is)^<(?:{element})[^>]*>(.*)</(?:{element})>$', 1)"


def absolute_sql(link: str) -> str:
    return f"""CASE WHEN {link} = '' OR regexp_matches({link}, '(?i)^(https?:|data:|mailto:|tel:|#)') THEN {link} WHEN starts_with({link}, '//') THEN 'https:' || {link}
        WHEN starts_with({link}, '/') THEN regexp_extract(url, '^[a-z]+://[^/]*') || {link} ELSE regexp_replace(url, '[^/]*$', '') || {link} END"""


def markdown_sql() -> str:
    """The converter's steps over PAGES, one after the other, each on what the one before left."""
    href, src = "regexp_extract(m, '(?is)^<a[^>]*href=\"([^\"]*)\"', 1)", "regexp_extract(m, '(?is)^<img[^>]*src=\"([^\"]*)\"', 1)"
    label, alt = bare_sql("regexp_extract(m, '(?is)^<a[^>]*>(.*)</a>$', 1)"), "regexp_extract(m, '(?is)alt=\"([^\"]*)\"', 1)"
    lf = "chr(10)"
    steps = [(f"(?is)<h{n}[^>]*>.*?</h{n}>", f"{lf} || '{'#' * n} ' || {bare_sql(inside_sql(f'h{n}'))} || {lf}") for n in range(1, 7)]
    steps += [
        ("(?is)<a[^>]*href=\"[^\"]*\"[^>]*>.*?</a>", f"CASE WHEN {label} = '' OR regexp_matches({href}, '^(#|javascript:)') THEN {label} ELSE '[' || {label} || '](' || {absolute_sql(href)} || ')' END"),
        ("(?is)<img[^>]*src=\"[^\"]*\"[^>]*>", f"'![' || {alt} || '](' || {absolute_sql(src)} || ')'"),
        ("(?is)<pre[^>]*><code[^>]*>.*?</code></pre>", f"{lf} || '```' || {lf} || {trim_sql(decoded_sql("regexp_extract(m, '(?is)<code[^>]*>(.*)</code></pre>$', 1)"))} || {lf} || '```' || {lf}"),
        ("(?is)<code[^>]*>.*?</code>", f"'`' || {decoded_sql(bare_sql(inside_sql('code')))} || '`'"),
        ("(?is)<strong[^>]*>.*?</strong>", f"'**' || {bare_sql(inside_sql('strong'))} || '**'"), ("(?is)<em[^>]*>.*?</em>", f"'*' || {bare_sql(inside_sql('em'))} || '*'"),
        ("(?is)<blockquote[^>]*>.*?</blockquote>", f"array_to_string(['> ' || {trim_sql('y')} || {lf} FOR y IN string_split({bare_sql(inside_sql('blockquote'))}, {lf})], '')"),
        ("(?is)<li[^>]*>.*?</li>", f"'- ' || {bare_sql(inside_sql('li'))} || {lf}"), ("(?i)</p>", f"{lf} || {lf}"), ("(?i)<br\\s*/?>|</div>", lf), ("(?i)<hr[^>]*>", f"{lf} || '---' || {lf}"),
    ]
    parts = ["t0 AS (SELECT doc_id, url, html, c AS t FROM c JOIN p USING (doc_id, url))".replace("c AS t", "c AS t")]
    parts += [f"t{i} AS (SELECT * REPLACE ({each_sql('t', a, b)} AS t) FROM t{i - 1})" for i, (a, b) in enumerate(steps, 1)]
    plain = decoded_sql("regexp_replace(t, '<[^>]+>', '', 'g')")
    spaced = trim_sql(f"regexp_replace(regexp_replace({plain}, '\\n{{3,}}', {lf} || {lf}, 'g'), '(?m)[ \\t]+$', '', 'g')")
    title = trim_sql(f"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{WS}+', ' ', 'g')")
    return f"{REGION}, {', '.join(parts)} SELECT doc_id, '# ' || {title} || {lf} || {lf} || {spaced} || {lf} AS md FROM t{len(steps)}"


@query("html_markdown", markdown_sql())
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-HTML-1 to 19b; each step is tested by hand-made vectors."""
    return pages(spark, sf_dir).select("doc_id", html.document(F.col("html"), F.col("url")).alias("md"))


@query("html_links", f"""WITH m AS ({markdown_sql()}), l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(md, '!?\\[[^\\[\\]]*\\]\\([^()\\s]*\\)'))) AS link FROM m) SELECT doc_id, link FROM l""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-HTML-5, 6, 9: the links and images of the converted pages."""
    md = pages(spark, sf_dir).select("doc_id", html.document(F.col("html"), F.col("url")).alias("md"))
    return md.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("md", F.lit(r"(!?\[[^\[\]]*\]\([^()\s]*\))"), F.lit(1)))).alias("link"))


def videos(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(raw, vtt, transcript, title, duration_s, and more columns asked for) of the youtube extractions, with caption files made of their segments."""
    stamp = lambda ms: F.concat(F.lpad(F.floor(F.col(ms) / 3600000).cast("string"), 2, "0"), F.lit(":"), F.date_format(F.timestamp_millis(F.col(ms) % 3600000), "mm:ss.SSS"))
    cue = F.concat(stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("\n"), F.regexp_replace("text", r"\n+", " "))
    cues = derived(spark, sf_dir, VTT, "segments").groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("seq", cue.alias("cue")))).alias("cues"))
    file = F.concat(F.lit("WEBVTT\n\n"), F.array_join("cues.cue", "\n\n"), F.lit("\n"))
    v = table(spark, sf_dir, "extractions").where("kind = 'youtube'").select("extraction_id", F.concat(F.lit("https://www.youtube.com/watch?v="), "source_id").alias("raw"), F.col("text").alias("transcript"), "title", (F.col("duration_ms") / 1000).alias("duration_s"))
    return v.dropDuplicates(["extraction_id"]).join(cues.select("extraction_id", file.alias("vtt")), "extraction_id", "left").drop(*[c for c in ("extraction_id",) if c not in more])


@query("flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, texts, videos with captions and all source forms through the engine: detection, slug, extraction, assembly (O-HTML-20 to 23, O-FILE-17 to 20).

    No table holds the bytes of files: pdf, docs and image sources reach their branch without content and fail there.
    """
    from quillmesh.plans.pipeline import Engine

    p = pages(spark, sf_dir).select(F.col("url").alias("raw"), "html")
    t = table(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("raw"), "text")
    s = sources(spark, sf_dir).select("raw")
    return Engine().run(p.unionByName(t, allowMissingColumns=True).unionByName(s, allowMissingColumns=True).unionByName(videos(spark, sf_dir), allowMissingColumns=True))


INJECTED = """SELECT doc_id, coalesce(text, '') || chr(10) || chr(10) || chr(10) || chr(10) || 'a' || chr(9) || chr(9) || 'b' || chr(10) || 'Please Sign up now' || chr(10) || 'see ACCEPT ALL rest' || chr(10) || 'end' AS t FROM documents"""


@query("clean_text", f"""SELECT doc_id, {trim_sql("regexp_replace(regexp_replace(regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(9) || '+', ' ', 'g'), '(?i)(?:Sign up|Log in|Sign in|Cookie|Accept all)[^' || chr(10) || chr(13) || chr(133) || chr(8232) || chr(8233) || ']*' || chr(10) || '?', '', 'g')")} AS t FROM ({INJECTED})""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-1."""
    return derived(spark, sf_dir, INJECTED, "documents").select("doc_id", textops.clean_text(F.col("t")).alias("t"))


STOP_SQL = r"""regexp_matches({0}, '[.!?:")]$')"""
OPEN_SQL = f"i > 1 AND ls[i - 1] <> '' AND NOT {STOP_SQL.format('ls[i - 1]')}"


@query("reflow", rf"""WITH t AS (SELECT DISTINCT extraction_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM extractions WHERE kind = 'pdf' AND text IS NOT NULL),
    l AS (SELECT extraction_id, t, [{trim_sql('y')} FOR y IN string_split(t, chr(10))] AS ls FROM t),
    j AS (SELECT extraction_id, t, regexp_replace(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN ls[i] = '' THEN CASE WHEN {OPEN_SQL} THEN chr(10) || chr(10) ELSE chr(10) END
        ELSE CASE WHEN {OPEN_SQL} THEN ' ' ELSE '' END || ls[i] || CASE WHEN {STOP_SQL.format('ls[i]')} THEN chr(10) ELSE '' END END), ''), '\n$', '') AS j FROM l)
    SELECT extraction_id, regexp_replace(CASE WHEN suffix(t, chr(10)) THEN regexp_replace(j, '\n$', '') ELSE j END, '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM j""")  # fmt: skip
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-2."""
    return table(spark, sf_dir, "extractions").where("kind = 'pdf' and text is not null").select("extraction_id", textops.reflowed(F.col("text")).alias("t")).distinct()


def breaks_sql(text: str) -> str:
    """The marks before which a paragraph breaks, one after the other; a match takes the character before it along."""
    for mark in (r"\d{1,3}\s*[—\-–]\s+\S", "→ ", r"[\x{1F300}-\x{1FAFF}]\s+[A-Z][A-Za-z &/]+", r"Update\s+[A-Z][a-z]+\s+\d+[, ]"):
        text = rf"regexp_replace({text}, '([^\n])\s({mark})', '\1' || chr(10) || chr(10) || '\2', 'g')"
    return text


WIDE_SQL = "length(" + trim_sql("{0}") + ") > 30"


@query("restored_breaks", rf"""WITH t AS (SELECT doc_id, string_split({breaks_sql("(text || ' 12 — next → go Update May 3, x')")}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN {WIDE_SQL.replace("{0}", "ls[i]")} AND {WIDE_SQL.replace("{0}", "coalesce(ls[i + 1], '')")} AND NOT regexp_matches(coalesce(ls[i + 1], ''), '^\s*[-*•]\s')
        AND regexp_matches(ls[i], '[.!?"'')\]…]\s*$') THEN ls[i] || chr(10) ELSE ls[i] END), chr(10)) AS t FROM t)
    SELECT doc_id, {trim_sql("regexp_replace(t, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS t FROM b""")  # fmt: skip
def restored_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-3."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", textops.restored_breaks(F.concat("text", F.lit(" 12 — next → go Update May 3, x"))).alias("t"))


METRICS = """SELECT doc_id, coalesce(text, '') || chr(10) || '14' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '1.9M' WHEN 1 THEN '> Views' ELSE 'words' END || chr(10) || chr(10) || 'Views' || chr(10) || 'Read 7 replies' || chr(10) || 'tail' || chr(10) || '12' || chr(10) || CASE doc_id % 2 WHEN 0 THEN chr(10) || chr(10) || 'May 3' ELSE 'last' END AS t FROM documents"""
BARE_SQL = trim_sql("regexp_replace(" + trim_sql("y") + r", '^(?:>\s*)+', '')")


@query("metric_strip", rf"""WITH t AS ({METRICS}), l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM t),
    f AS (SELECT doc_id, ls, [{BARE_SQL} FOR y IN ls] AS bs, [{trim_sql('y')} FOR y IN ls] AS ts FROM l),
    m AS (SELECT doc_id, ls, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN bs[i] <> '' AND (regexp_matches(bs[i], '{textops.METRIC_LINE}') OR list_contains([{", ".join("'" + w + "'" for w in textops.METRIC_WORDS)}], bs[i])) THEN 'm' WHEN ts[i] IN ('', '>') THEN 'b' ELSE 't' END), '') AS marks FROM f),
    x AS (SELECT doc_id, ls, array_to_string([CASE WHEN length(g) > 1 AND g[1] = 'm' THEN repeat('x', length(g)) ELSE g END FOR g IN regexp_extract_all(marks, 'm(?:b?m)+|.')], '') AS marks FROM m),
    k AS (SELECT doc_id, array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF marks[i] <> 'x'], chr(10)) AS t FROM x)
    SELECT doc_id, {trim_sql("regexp_replace(t, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS t FROM k""")  # fmt: skip
def metric_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-6."""
    return derived(spark, sf_dir, METRICS, "documents").select("doc_id", textops.without_metrics(F.col("t")).alias("t"))


CHROME = """SELECT doc_id, coalesce(text, '') || chr(10) || 'kept ' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '- Trending now' WHEN 1 THEN 'Who to follow' WHEN 2 THEN 'Show more' || chr(10) || 'Terms' ELSE 'nothing of that' END || chr(10) || 'x' || chr(10) || 'Read 3 replies' || CASE WHEN doc_id % 8 > 5 THEN ' more' ELSE '' END || chr(10) AS t FROM documents"""
CHROME_AT = "(?m)(?:" + "|".join([*(r"^(?:-\s+)?" + p for p in textops.CHROME_STARTS), r"^Show more$\nTerms"]).replace("'", "''") + ")"


@query("chrome_cut", rf"""WITH t AS ({CHROME}), h AS (SELECT doc_id, t, string_split_regex(t, '{CHROME_AT}')[1] AS head FROM t)
    SELECT doc_id, CASE WHEN head <> t THEN regexp_replace(head, '\s+$', '') || chr(10) ELSE t END AS t FROM h""")  # fmt: skip
def chrome_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-7."""
    return derived(spark, sf_dir, CHROME, "documents").select("doc_id", textops.cut_at_chrome(F.col("t")).alias("t"))


BROKEN = """SELECT doc_id, coalesce(text, '') || ' see https://' || chr(10) || 'e.example' || chr(10) || '/a' || CAST(doc_id AS STRING) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '/b' || chr(10) ELSE '' END || chr(10) || 'then http://y.example/' || coalesce(lang, 'z') || '… more http://' || chr(10) || 'two words' || chr(10) AS t FROM documents"""


@query("broken_urls", rf"""WITH t AS ({BROKEN})
    SELECT doc_id, regexp_replace(list_reduce(list_prepend(t, list_distinct(regexp_extract_all(t, 'https?://\n(?:[a-zA-Z0-9._/\-?=&%#~+]+\n){{1,6}}'))), lambda acc, m: replace(acc, m, replace(m, chr(10), ''))), '(https?://\S+)…', '\1', 'g') AS t FROM t""")  # fmt: skip
def broken_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-8."""
    return derived(spark, sf_dir, BROKEN, "documents").select("doc_id", textops.joined_urls(F.col("t")).alias("t"))


@query("merge_inline")
def merge_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-4, 5."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", textops.merged_lines(F.regexp_replace("text", r" (?=[a-z]{4})", "\n")).alias("merged"), textops.colon_lists(F.concat(F.lit("What we think:\n"), F.regexp_replace("text", r"(?<=\.) ", "\n"))).alias("listed"))


@query("scalar_cleanups", f"""SELECT doc_id, left(coalesce(text, ''), 50) AS head, {trim_sql("regexp_replace(regexp_replace('<p>' || coalesce(lang, '') || '</p><b>x' || chr(10) || ' y</b>', '<[^>]+>', ' ', 'g'), '[ \\t\\n]+', ' ', 'g')")} AS tagless, doc_id % 13 AS entry,
    'a' || chr(10) || chr(10) || 'b' AS commentless FROM documents""")
def scalar_cleanups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-9, 10, 15, 16."""
    d = table(spark, sf_dir, "documents")
    tagged = F.concat(F.lit("<p>"), F.coalesce("lang", F.lit("")), F.lit("</p><b>x\n y</b>"))
    name = F.concat(F.lit("ppt/slides/slide"), (F.col("doc_id") % 13).cast("string"), F.lit(".xml"))
    return d.select(
        "doc_id", textops.body_cap(F.coalesce("text", F.lit("")), 50).alias("head"), textops.tag_text(tagged).alias("tagless"), textops.entry_number(name).cast("bigint").alias("entry"),
        textops.without_comments(F.lit("<!-- image -->\na\n\n  <!-- x -->  \n\nb\n")).alias("commentless"),
    )


def short_sql(title: str, most: str) -> str:
    """A title within a limit, as short_name has it."""
    stop = f"list_max([i FOR i IN range(CAST(floor(({most} - 1) * 0.8) AS BIGINT), {most}) IF substring({title}, i + 1, 1) IN (':', '—', '|', ',', '。')])"
    space = f"list_max([i FOR i IN range(1, {most}) IF regexp_matches(substring({title}, i + 1, 1), '^\\s$')])"
    return f"CASE WHEN length({title}) <= {most} THEN {title} ELSE CASE WHEN {stop} IS NOT NULL THEN rtrim(left({title}, {stop} + 1)) WHEN {space} IS NOT NULL THEN rtrim(left({title}, {space})) ELSE left({title}, {most} - 1) END || '…' END"


@query("notebook_name", f"""SELECT DISTINCT title, {short_sql('title', '24')} AS short, concat_ws(' • ', 'quillmesh[t] ', {short_sql('title', 'greatest(20, 60 - length(' + chr(39) + 'quillmesh[t] ' + chr(39) + ') - 9 - 11 - 10)')}, 'abcdefgh123', '2024-05-06') AS name FROM extractions WHERE title IS NOT NULL""")
def notebook_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TXT-11, 12."""
    d = table(spark, sf_dir, "extractions").where("title is not null")
    return d.select("title", textops.short_name(F.col("title"), 24).alias("short"), textops.notebook_name(F.col("title"), F.lit("abcdefgh123"), F.lit("2024-05-06"), 60, "t").alias("name")).distinct()


@query("rows_to_grid", """WITH n AS (SELECT r_regionkey, '| ' || CAST(n_nationkey AS STRING) || ' | ' || trim(n_name) || ' |' AS l, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_regionkey, '| key | na\\|me |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(l, chr(10) ORDER BY n_nationkey) AS md FROM n GROUP BY r_regionkey""")  # fmt: skip
def rows_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TBL-1."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit("")).alias("r")))), lambda x: x["r"])
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("na|me"))), cells, F.array(F.array(F.lit(" "), F.lit(""))))
    return n.groupBy("r_regionkey").agg(tables.grid(rows).alias("md"))


@query("html_grid", """SELECT doc_id, '**Cap**' || chr(10) || chr(10) || '| a | b|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || CAST(doc_id AS STRING) || ' | x\\|y |' || chr(10) || '| wide |  |' || chr(10) || chr(10) || 'After' AS md FROM documents""")
def html_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TBL-2."""
    h = F.concat(F.lit("<table><tr><td colspan=2>Cap</td></tr><tr><td> a </td><td>b|c</td></tr><tr><td>"), F.col("doc_id").cast("string"), F.lit("</td><td>x|y</td></tr><tr><td>wide</td></tr><tr><td colspan='2'>After</td></tr></table>"))
    return table(spark, sf_dir, "documents").select("doc_id", tables.html_grid(h).alias("md"))


@query("caption_parse", f"""WITH s AS ({VTT}), c AS (SELECT *, {trim_sql("regexp_replace(text, '<[^>]+>', '', 'g')")} AS x FROM s)
    SELECT extraction_id, seq, start_ms, end_ms, regexp_replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '[ \\t\\n\\r\\f\\x0B\\x{{00A0}}]+$', '') AS text
    FROM c WHERE x <> '' AND start_ms IS NOT NULL AND end_ms IS NOT NULL""")  # fmt: skip
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-1, 2, O-TXT-14: each cue written as a caption file and read again."""
    s = derived(spark, sf_dir, VTT, "segments")
    stamp = lambda c: F.expr(STAMP.format(c))
    file = F.concat(F.lit("WEBVTT\nKind: captions\n\n1\n"), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit(" align:start\n"), F.regexp_replace("text", r"\n+", " "), F.lit("\n\n"))
    return s.select("extraction_id", "seq", F.explode(captions.parsed_cues(file)).alias("c")).select("extraction_id", "seq", "c.start_ms", "c.end_ms", "c.text")


@query("rolling_merge", f"""WITH s AS ({VTT}), g AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY extraction_id ORDER BY seq) = text THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY extraction_id ORDER BY seq) AS run FROM g)
    SELECT extraction_id, min(seq) AS seq, min(start_ms) AS start_ms, arg_max(end_ms, seq) AS end_ms, min(text) AS text, count(*) AS n FROM r GROUP BY extraction_id, run""")  # fmt: skip
def rolling_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-3."""
    s = derived(spark, sf_dir, VTT, "segments")
    return captions.merged_rows(s, "extraction_id", "seq", "text", "start_ms", "end_ms").select("extraction_id", "seq", "start_ms", "end_ms", "text", "n")


@query("gap_paragraphs", f"""WITH s AS ({VTT}), g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY extraction_id ORDER BY seq) > 1500 THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY extraction_id ORDER BY seq) AS para FROM g)
    SELECT extraction_id, CAST(para AS BIGINT) AS para, min(start_ms) AS start_ms, arg_max(end_ms, seq) AS end_ms, string_agg(text, ' ' ORDER BY seq) AS text FROM r GROUP BY extraction_id, para""")  # fmt: skip
def gap_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-4."""
    return captions.paragraphs(derived(spark, sf_dir, VTT, "segments"), "extraction_id", "seq", "text", "start_ms", "end_ms")


@query("transcript_slices", rf"""WITH e AS (SELECT DISTINCT extraction_id, text, duration_ms FROM extractions WHERE text IS NOT NULL AND duration_ms IS NOT NULL),
    p AS (SELECT extraction_id, duration_ms, [x FOR x IN [{trim_sql('y')} FOR y IN string_split_regex(text, '\n[ \t]*\n+')] IF x <> ''] AS ps FROM e),
    u AS (SELECT extraction_id, duration_ms, ps, CAST(floor(duration_ms / len(ps)) AS BIGINT) AS part, unnest(range(0, len(ps))) AS i FROM p)
    SELECT extraction_id, CAST(i AS INTEGER) AS i, i * part AS start_ms, CASE WHEN i = len(ps) - 1 THEN duration_ms ELSE (i + 1) * part END AS end_ms, ps[i + 1] AS text FROM u""")  # fmt: skip
def transcript_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-5."""
    e = table(spark, sf_dir, "extractions").where("text is not null and duration_ms is not null").dropDuplicates(["extraction_id"])
    return e.select("extraction_id", F.posexplode(captions.transcript_slices(F.col("text"), F.col("duration_ms"))).alias("i", "s")).select("extraction_id", "i", "s.start_ms", "s.end_ms", "s.text")


TRACKS = "SELECT source, lang, min(doc_id) AS ord, CASE WHEN min(doc_id) % 2 = 0 THEN 'uploader' ELSE 'auto-generated' END AS origin FROM documents WHERE lang IS NOT NULL GROUP BY source, lang"


@query("track_select", f"""WITH t AS ({TRACKS}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' AND origin = 'uploader' THEN 0 WHEN origin = 'uploader' THEN 1 WHEN lang = 'en' THEN 2 ELSE 3 END, ord) AS n FROM t)
    SELECT source AS video, lang, origin FROM r WHERE n = 1""")  # fmt: skip
def track_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-7."""
    t = derived(spark, sf_dir, TRACKS, "documents").select(F.col("source").alias("video"), "ord", "lang", F.col("origin").alias("source"))
    return captions.chosen_track_rows(t, "video", "ord").select("video", "lang", F.col("source").alias("origin"))


@query("track_union", f"""WITH t AS ({TRACKS}), a AS (SELECT source, list(lang ORDER BY ord) FILTER (origin = 'uploader') AS u, list(lang ORDER BY ord) AS a FROM t GROUP BY source)
    SELECT source AS video, CAST(len(a) AS BIGINT) AS n, array_to_string(list_concat(coalesce(u, []), [x FOR x IN a IF NOT list_contains(coalesce(u, []), x)]), ',') AS langs FROM a""")  # fmt: skip
def track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-6: uploaded languages, then automatic ones, which every video has in all languages."""
    t = derived(spark, sf_dir, TRACKS, "documents")
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "lang")))), lambda x: x["lang"])
    a = t.groupBy(F.col("source").alias("video")).agg(listed(F.col("origin") == "uploader").alias("u"), listed(F.lit(True)).alias("a"))
    langs = captions.track_list(F.col("u"), F.col("a"))
    return a.select("video", F.size(langs).cast("bigint").alias("n"), F.array_join(F.transform(langs, lambda x: x["lang"]), ",").alias("langs"))


MESSAGES = """SELECT o_orderkey, o_orderdate, o_totalprice, CASE o_orderkey % 5 WHEN 0 THEN 'This video is PRIVATE: ' WHEN 1 THEN 'Members-only content, ' WHEN 2 THEN 'Video unavailable in your country ' ELSE 'Connection reset ' END || o_orderpriority AS message FROM orders"""


@query("video_meta", f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted, CAST(round_even(o_totalprice * 1000, 0) AS BIGINT) AS duration_ms,
    CASE WHEN regexp_matches(lower(message), 'private|age|members-only|sign in|unavailable in your country') THEN 40 ELSE 10 END AS exit_code FROM ({MESSAGES})""")  # fmt: skip
def video_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-8, 9."""
    o = derived(spark, sf_dir, MESSAGES, "orders")
    return o.select("o_orderkey", captions.iso_day(F.date_format("o_orderdate", "yyyyMMdd")).alias("posted"), captions.whole_ms(F.col("o_totalprice")).alias("duration_ms"), captions.restriction_exit(F.col("message")).alias("exit_code"))


PAGED = f"SELECT extraction_id, seq, seq // 4 AS page, text FROM ({VTT})"


@query("page_group", f"""WITH p AS ({PAGED}), g AS (SELECT extraction_id, page, min(seq) AS f, string_agg(text, chr(10) ORDER BY seq) AS text FROM p WHERE length(text) > 0 GROUP BY extraction_id, page)
    SELECT extraction_id, CAST(row_number() OVER (PARTITION BY extraction_id ORDER BY f) - 1 AS INTEGER) AS segment, page, text FROM g""")  # fmt: skip
def page_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-FILE-12."""
    p = derived(spark, sf_dir, VTT, "segments").withColumn("page", F.floor(F.col("seq") / 4).cast("int"))
    return files.grouped_pages(p, "extraction_id", "seq", "page", "text")


@query("success_body", f"""WITH d AS (SELECT doc_id, coalesce(title, '') AS title, {trim_sql("CASE WHEN doc_id % 3 = 0 THEN '# ' ELSE '' END || coalesce(text, '')")} AS b FROM documents)
    SELECT doc_id, CASE WHEN b = '' THEN '' WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN chr(10) || b || chr(10) ELSE chr(10) || '# ' || title || chr(10) || chr(10) || b || chr(10) END AS body,
        CAST(round_even(doc_id / 2, 0) AS BIGINT) AS seconds FROM d""")  # fmt: skip
def success_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-1."""
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "# ").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", sinks.markdown_body(t, F.coalesce("title", F.lit(""))).alias("body"), sinks.whole_seconds(F.col("doc_id") * 500).alias("seconds"))


def scalar_sql(v: str) -> str:
    return rf"CASE WHEN regexp_matches({v}, '^\p{{L}}(?:[\p{{L}}\p{{N}} _-]*[\p{{L}}\p{{N}}_-])?$') AND lower({v}) NOT IN ('true', 'false', 'null', 'yes', 'no', 'on', 'off') THEN {v} ELSE CAST(to_json({v}) AS VARCHAR) END"


def front_sql(*fields: tuple[str, str, bool]) -> str:
    """Front matter from (name, value, whether it is a string)."""
    return "'---' || chr(10) || " + " || ".join(f"coalesce(CASE WHEN CAST({v} AS VARCHAR) <> '' THEN '{k}: ' || {scalar_sql(v) if text else f'CAST({v} AS VARCHAR)'} || chr(10) END, '')" for k, v, text in fields) + " || '---' || chr(10)"


NAMED = "e AS (SELECT * REPLACE (coalesce(slug, 'none') || '--' || CAST(extraction_id AS STRING) AS slug) FROM extractions QUALIFY row_number() OVER (PARTITION BY extraction_id ORDER BY arrived_at) = 1)"
HEAD = front_sql(*[(n, n, True) for n in ("source", "source_id", "title", "slug", "author")], ("duration_seconds", "CAST(round_even(duration_ms / 1000, 0) AS BIGINT)", False), ("posted", "posted", True), ("kind", "kind", True), ("extractor_detail", "regexp_replace(regexp_replace(to_json({'extractor': extractor.extractor, 'structured': extractor.structured, 'ext': extractor.ext, 'caption_lang': extractor.caption_lang, 'caption_source': extractor.caption_source}), '\"[a-z_]+\":null,', '', 'g'), ',\"[a-z_]+\":null', '', 'g')", False), ("language", "language", True), ("extracted_at", "extracted_at", True), ("status", "'success'", True))
STUB = front_sql(*[(n, n, True) for n in ("source", "source_id", "slug", "kind", "title")], ("status", "'failed'", True), ("exit_code", "exit_code", False), ("extractor_attempted", "to_json(CASE WHEN kind IS NULL THEN [] ELSE [kind] END)", False), ("error", "error", True), ("attempted_at", "extracted_at", True))


@query("success_files", rf"""WITH {NAMED}, b AS (SELECT *, {trim_sql('text')} AS b FROM e WHERE status = 'success')
    SELECT slug, {HEAD} || CASE WHEN b = '' THEN '' WHEN regexp_matches(b, '^#{{1,6}}\s') THEN chr(10) || b || chr(10) ELSE chr(10) || '# ' || title || chr(10) || chr(10) || b || chr(10) END AS md,
        CAST(to_json({{'status': status, 'kind': kind, 'extractor_detail': extractor, 'metadata': {{'source': source, 'source_id': source_id, 'title': title, 'slug': slug, 'author': author, 'duration_ms': duration_ms, 'posted': posted, 'language': language}}, 'text': text, 'segments': segments, 'extracted_at': extracted_at}}) AS VARCHAR) AS json FROM b""")  # fmt: skip
def success_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-1, 2: front matter with body, and the JSON payload."""
    e = table(spark, sf_dir, "extractions").dropDuplicates(["extraction_id"]).withColumn("slug", F.concat(F.coalesce("slug", F.lit("none")), F.lit("--"), F.col("extraction_id").cast("string")))
    return sinks.success_markdown(e).join(sinks.success_json(e), "slug")


@query("failure_stubs", rf"""WITH {NAMED} SELECT slug, {STUB} || chr(10) || '(no body - extraction failed; run again with force)' || chr(10) AS md,
    CAST(to_json({{'status': status, 'kind': kind, 'source': source, 'source_id': source_id, 'slug': slug, 'title': nullif(title, ''), 'exit_code': exit_code, 'extractor_attempted': CASE WHEN kind IS NULL THEN [] ELSE [kind] END, 'error': error, 'attempted_at': extracted_at}}) AS VARCHAR) AS json FROM e WHERE status = 'failed'""")  # fmt: skip
def failure_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-3, O-FILE-19, 20."""
    e = table(spark, sf_dir, "extractions").dropDuplicates(["extraction_id"]).withColumn("slug", F.concat(F.coalesce("slug", F.lit("none")), F.lit("--"), F.col("extraction_id").cast("string")))
    return sinks.failure_stub(e)


@query("cache_lookup", """WITH r AS (SELECT DISTINCT source_id, slug FROM extractions WHERE status = 'success'), s AS (SELECT DISTINCT source_id, regexp_replace(slug, '--.*$', '') AS slug FROM extractions)
    SELECT source_id, slug FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = s.source_id AND (r.slug = s.slug OR starts_with(r.slug, s.slug || '--'))) AND source_id IS NOT NULL AND slug IS NOT NULL""")  # fmt: skip
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-4."""
    e = table(spark, sf_dir, "extractions")
    s = e.select("source_id", F.regexp_replace("slug", "--.*$", "").alias("slug")).distinct().where("source_id is not null and slug is not null")
    return sinks.uncached(s, e.select("source_id", "slug", "status")).select("source_id", "slug")


@query("cache_hits", """WITH r AS (SELECT DISTINCT source_id, slug FROM extractions WHERE status = 'success'), s AS (SELECT DISTINCT source_id, slug FROM extractions WHERE slug IS NOT NULL)
    SELECT s.source_id, s.slug, min(r.slug) AS hit_slug FROM s JOIN r ON r.source_id = s.source_id AND (r.slug = s.slug OR starts_with(r.slug, s.slug || '--')) GROUP BY ALL""")  # fmt: skip
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-7, 8."""
    e = table(spark, sf_dir, "extractions")
    return sinks.cached(e.where("slug is not null").select("source_id", "slug").distinct(), e.select("source_id", "slug", "status"))


@query("event_log", """WITH e AS (SELECT DISTINCT extraction_id, source_id, kind, slug, status, error FROM extractions), s AS (SELECT unnest([0, 1, 2]) AS step)
    SELECT source_id, kind, slug, CAST(step AS INTEGER) AS step, CASE step WHEN 0 THEN 'started' WHEN 1 THEN 'detected' ELSE CASE status WHEN 'success' THEN 'success' ELSE 'failed' END END AS event, CASE WHEN step = 2 AND status <> 'success' THEN error END AS error FROM e, s""")  # fmt: skip
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SINK-6, 9."""
    e = table(spark, sf_dir, "extractions").select("extraction_id", "source_id", "kind", "slug", "status", "error").distinct()
    return sinks.event_rows(e)


@query("final_state", """WITH o AS (SELECT log_id, source_id, event, ts FROM extract_log WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY arrived_at) = 1)
    SELECT source_id, arg_max(event, (ts, log_id)) FILTER (event IN ('cache_hit', 'success', 'failed')) AS final_event, count(*) AS n_events FROM o GROUP BY source_id""")  # fmt: skip
def final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event state machine over the whole log."""
    return sinks.final_state(table(spark, sf_dir, "extract_log"))


IMAGES = """SELECT doc_id, 'https://pbs.twimg.com/media/' || coalesce(lang, 'x') || CAST(doc_id % 7 AS STRING) || '?x=1' AS a, 'https://pbs.twimg.com/media/' || coalesce(lang, 'x') || CAST(doc_id % 5 AS STRING) || '&y=2' AS b, 'https://img.example/' || CAST(doc_id % 3 AS STRING) || '.png' AS c FROM documents"""
KEY_SQL = "coalesce(nullif(regexp_extract({0}, 'pbs[.]twimg[.]com/media/([A-Za-z0-9_-]+)', 1), ''), {0})"


@query("thread_images", f"""SELECT doc_id, CAST(len(list_distinct([a, b, a, c])) AS BIGINT) AS n_images, ka <> kb AS first_kept, NOT list_contains(CASE WHEN ka = kb THEN [ka] ELSE [ka, kb] END, kc) AND kc <> ka AND NOT list_contains(CASE WHEN ka = kb THEN [ka] ELSE [ka, kb] END, ka) AS second_kept
    FROM (SELECT *, {KEY_SQL.format('a')} AS ka, {KEY_SQL.format('b')} AS kb, {KEY_SQL.format('c')} AS kc FROM ({IMAGES}))""")  # fmt: skip
def thread_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X-3, 6: the second section repeats the first one's first image."""
    d = derived(spark, sf_dir, IMAGES, "documents")
    kept = social.sections_without_repeats(F.array(F.array("a", "b"), F.array("c", "a")))
    return d.select("doc_id", F.size(social.image_list(F.array("a", "b", "a", "c"))).cast("bigint").alias("n_images"), F.get(kept, 0).alias("first_kept"), F.get(kept, 1).alias("second_kept"))


ENTRIES = """SELECT doc_id, coalesce(replace(title, chr(10), ' '), '') || CASE doc_id % 3 WHEN 0 THEN ' @bob said' ELSE ' said' END || chr(10) || coalesce(lang, 'rest') AS one, 'quoted ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || coalesce(source, 'end') AS two, CASE WHEN doc_id % 2 = 0 THEN coalesce(item_id, '') ELSE '' END AS three FROM documents"""


@query("thread_text", f"""WITH e AS ({ENTRIES}), q AS (SELECT *, array_to_string([CASE WHEN y = '' THEN '>' ELSE '> ' || y END FOR y IN string_split(two, chr(10))], chr(10)) AS quote FROM e),
    u AS (SELECT *, CASE WHEN contains(string_split(one, chr(10))[1], '@bob') THEN string_split(one, chr(10))[1] || chr(10) || chr(10) || quote || chr(10) || string_split(one, chr(10))[2] ELSE one || chr(10) || chr(10) || '---' || chr(10) || chr(10) || two END AS t FROM q)
    SELECT doc_id, CASE WHEN three = '' THEN t ELSE t || chr(10) || chr(10) || '---' || chr(10) || chr(10) || three END AS t FROM u""")  # fmt: skip
def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X-2, 4: a second entry is quoted under the line that names its handle, others are appended."""
    entry = lambda h, c: F.struct(F.lit(h).cast("string").alias("handle"), F.col(c).alias("section"))
    return derived(spark, sf_dir, ENTRIES, "documents").select("doc_id", social.thread_text(F.array(entry("ann", "one"), entry("bob", "two"), entry(None, "three"))).alias("t"))


@query("thread_body")
def thread_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X-1, 5."""
    item = lambda v: F.struct(F.lit("text").alias("type"), v.alias("value"), F.lit(None).cast("string").alias("url"))
    items = F.array(item(F.lit("Jane Doe\n@jane\n")), item(F.concat(F.lit("A short headline\n107\n3.9K\n"), F.coalesce("text", F.lit("")))))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.get(social.body_items(items), 0)["value"].alias("lead"), social.handle_of(items).alias("handle"), textops.conversation_part(F.concat(F.lit("Conversation\n"), F.coalesce("text", F.lit("")), F.lit("\nShow this thread"))).alias("part"))


LINKED = """SELECT doc_id, coalesce(text, '') || ' see https://t.co/k' || CAST(doc_id % 50 AS STRING) || ' and https://t.co/none' || CAST(doc_id AS STRING) || ', https://t.co/k' || CAST(doc_id % 7 AS STRING) AS t FROM documents"""
TARGETS = """SELECT DISTINCT 'https://t.co/k' || CAST(doc_id % 40 AS STRING) AS link, 'https://long.example/' || CAST(doc_id % 40 AS STRING) AS target FROM documents"""


@query("short_links", f"""WITH l AS ({LINKED}), u AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, 'https?://t[.]co/\\w+'))) AS link FROM l), k AS (SELECT doc_id, link, target FROM u JOIN ({TARGETS}) USING (link)),
    g AS (SELECT doc_id, list({{'a': link, 'b': target}} ORDER BY length(link) DESC) AS ks FROM k GROUP BY doc_id)
    SELECT doc_id, CASE WHEN ks IS NULL THEN t ELSE list_reduce(list_prepend(t, [x.a || ' ' || x.b FOR x IN ks]), lambda acc, x: regexp_replace(acc, string_split(x, ' ')[1] || '\\b', string_split(x, ' ')[2], 'g')) END AS t FROM l LEFT JOIN g USING (doc_id)""")  # fmt: skip
def short_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SRC-16: links resolved by a table."""
    return linked_texts(derived(spark, sf_dir, LINKED, "documents"), derived(spark, sf_dir, TARGETS, "documents"), "doc_id", "t")


def _pages_engine(data: bytes) -> dict:
    """Stands in for a page engine: a page for each stretch up to a full stop and a space, some numbered from a start of their own."""
    parts = data.decode().split(". ")
    return {"tier": "pymupdf4llm", "chunks": [{"text": p, "metadata": {"page": i + len(parts)} if len(parts) % 2 else {"page_number": i + 1}} for i, p in enumerate(parts)]}


@query("engine_pages", """WITH p AS (SELECT DISTINCT extraction_id, string_split(text, '. ') AS ps FROM extractions WHERE status = 'success' AND kind = 'pdf' AND regexp_matches(text, '\\S')),
    u AS (SELECT extraction_id, len(ps) AS n, unnest(range(0, len(ps))) AS i, unnest(ps) AS x FROM p), t AS (SELECT extraction_id, n, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM u), k AS (SELECT * FROM t WHERE x <> '')
    SELECT extraction_id, CAST(row_number() OVER (PARTITION BY extraction_id ORDER BY i) - 1 AS INTEGER) AS segment, CAST(CASE WHEN n % 2 = 1 THEN i + n + 1 ELSE i + 1 END AS INTEGER) AS page, x AS text, 'pymupdf4llm' AS extractor FROM k""")  # fmt: skip
def engine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-FILE-2, 11, 14, O-EXT-4: PDFs by an engine handed to the workers, exploded into their pages with locators."""
    from quillmesh.plans.pipeline import Engine

    e = table(spark, sf_dir, "extractions").where("status = 'success' and kind = 'pdf'").where(F.col("text").rlike(r"\S")).select("extraction_id", "text").distinct()
    s = e.select(F.concat(F.lit("/scans/"), F.col("extraction_id").cast("string"), F.lit(".pdf")).alias("raw"), F.col("text").cast("binary").alias("content"))
    got = Engine(engines={"pdf": [_pages_engine]}).run(s, provider="pdf")
    pages_ = got.select(F.regexp_extract("raw", r"(\d+)\.pdf$", 1).cast("bigint").alias("extraction_id"), "extractor", F.explode(F.arrays_zip("segments", F.col("detail.locators").alias("locators"))).alias("z"))
    return pages_.select("extraction_id", "z.locators.segment", "z.locators.page", "z.segments.text", "extractor")


@query("engine_cues", f"""WITH y AS (SELECT DISTINCT extraction_id FROM extractions WHERE kind = 'youtube'), s AS (SELECT s.* FROM ({VTT}) s JOIN y USING (extraction_id)),
    c AS (SELECT extraction_id, seq, start_ms, end_ms, {trim_sql(decoded_sql("regexp_replace(regexp_replace(text, '" + chr(92) + "n+', ' ', 'g'), '<[^>]+>', '', 'g')").replace(", '&nbsp;', ' ')", ", '', '')"))} AS text FROM s), k AS (SELECT * FROM c WHERE text <> ''),
    f AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY extraction_id ORDER BY seq) = text THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY extraction_id ORDER BY seq) AS run FROM f)
    SELECT extraction_id, CAST(run - 1 AS INTEGER) AS segment, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, any_value(text) AS text FROM r GROUP BY extraction_id, run""")  # fmt: skip
def engine_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-SEG-2, 3, 10: videos through the engine, exploded into their cues."""
    from quillmesh.plans.pipeline import Engine

    v = videos(spark, sf_dir, "extraction_id").select(F.concat(F.lit("https://youtu.be/"), F.lpad(F.col("extraction_id").cast("string"), 11, "0")).alias("raw"), "vtt")
    got = Engine().run(v.where("vtt is not null"), provider="youtube").where("extractor = 'captions'")
    cues = got.select(F.regexp_extract("raw", r"(\d+)$", 1).cast("bigint").alias("extraction_id"), F.posexplode("segments").alias("segment", "s"))
    return cues.select("extraction_id", "segment", "s.start_ms", "s.end_ms", "s.text")


@F.pandas_udf(T.BinaryType())
def _office_file(form: pd.Series, title: pd.Series, slug: pd.Series, kind: pd.Series) -> pd.Series:
    """A small document, slide show or workbook of the values."""

    def made(form: str, *values: str) -> bytes:
        t, s, k = (html_escape(v) for v in values)
        grid = "".join(f"<tr>{''.join(f'<tc><p><r><t>{x}</t></r></p></tc>' for x in row)}</tr>" for row in (("kind", "slug"), (k, s)))
        entries = {
            "docx": {"word/document.xml": f'<document xmlns:w="w"><body><p><pPr><pStyle w:val="Heading2"/></pPr><r><t>{t}</t></r></p><p><r><t>{s}</t></r></p><tbl>{grid}</tbl></body></document>'},
            "pptx": {"ppt/slides/slide1.xml": f"<sld><sp><txBody><p><r><t>{t}</t></r></p><p><r><t>{s}</t></r></p></txBody></sp></sld>", "ppt/slides/slide2.xml": f"<sld><graphicFrame><tbl>{grid}</tbl></graphicFrame></sld>"},
            "xlsx": {"xl/workbook.xml": f'<workbook><sheets><sheet name="{k}"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet><row><c r="A1" t="inlineStr"><is><t>{t}</t></is></c><c r="B1"><v>7</v></c></row><row><c r="B2" t="inlineStr"><is><t>{s}</t></is></c></row></worksheet>'},
        }[form]
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for name, text in entries.items():
                z.writestr(name, text)
        return b.getvalue()

    return pd.Series([made(*values) for values in zip(form, title, slug, kind, strict=True)])


OFFICE = """SELECT DISTINCT extraction_id, CASE extraction_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' ELSE 'xlsx' END AS form, trim(title) AS title, slug, kind FROM extractions WHERE title IS NOT NULL AND trim(title) <> '' AND slug IS NOT NULL AND slug <> '' AND kind IS NOT NULL"""
GRID_SQL = "'| kind | slug |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || kind || ' | ' || slug || ' |'"


@query("office_text", f"""SELECT extraction_id, CASE form WHEN 'docx' THEN '## ' || title || chr(10) || chr(10) || slug || chr(10) || chr(10) || {GRID_SQL}
    WHEN 'pptx' THEN '## Slide 1' || chr(10) || chr(10) || title || chr(10) || slug || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || {GRID_SQL}
    ELSE '## ' || kind || chr(10) || chr(10) || '| ' || replace(title, '|', chr(92) || '|') || ' | 7 |' || chr(10) || '| --- | --- |' || chr(10) || '|  | ' || slug || ' |' END AS text,
    CAST(CASE form WHEN 'docx' THEN 0 WHEN 'pptx' THEN 2 ELSE 1 END AS INTEGER) AS n_segments FROM ({OFFICE})""")  # fmt: skip
def office_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-TBL-3 to 5, O-FILE-3 to 7, 15: office files made of the table's values, read back with their structure."""
    from quillmesh.plans.pipeline import Engine

    d = derived(spark, sf_dir, OFFICE, "extractions")
    s = d.select(F.concat(F.lit("/office/"), F.col("extraction_id").cast("string"), F.lit("."), "form").alias("raw"), _office_file("form", "title", "slug", "kind").alias("content"))
    got = Engine().run(s, provider="docs")
    return got.select(F.regexp_extract("raw", r"(\d+)\.\w+$", 1).cast("bigint").alias("extraction_id"), "text", F.size("segments").alias("n_segments"))


@query("widget_strip", """SELECT doc_id, 'One' || chr(10) || '- item' || chr(10) || 'flat ' || CAST(doc_id AS STRING) || chr(10) || '## Two' || chr(10) || 'see [a](https://h.example/x/y) ![i](https://h.example/p/i.png) [s](../../assets/' || coalesce(lang, 'x') || '/s.png) ![t](/assets/t.png) [w](Word) [u](https://h.example/' || coalesce(lang, 'x') || '/u)' AS t FROM documents""")
def widget_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-HTML-21, 22."""
    t = F.concat(F.lit("Skip to main content\nOne\n  - item\n    flat "), F.col("doc_id").cast("string"), F.lit("\n- Embed\n3/10 completed\n##\n## ​Two\n- [Star\n1,088](u)You must be signed in\nsee [a](/x/y) ![i](i.png) [s](../../assets/"), F.coalesce("lang", F.lit("x")), F.lit("/s.png) ![t](/assets/t.png) [w](Word) [u](../"), F.coalesce("lang", F.lit("x")), F.lit("/u)"))
    return table(spark, sf_dir, "documents").select("doc_id", html.without_widgets(html.relative_links(t, F.lit("https://h.example/p/q"))).alias("t"))
