"""Queries of keys and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout, strings as S, urls as U
from .catalog import query, read

PATH = "lang || '/' || source || '/Doc-' || doc_id || '.JPG'"


def paths(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit("/"), "source", F.lit("/Doc-"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("path"))


@query("F1_basename", "SELECT doc_id, 'Doc-' || doc_id || '.JPG' AS name FROM documents")
def f1(spark, d):
    return paths(spark, d).select("doc_id", S.basename(F.col("path")).alias("name"))


@query("F2_basename_lower", "SELECT doc_id, 'doc-' || doc_id || '.jpg' AS name FROM documents")
def f2(spark, d):
    return paths(spark, d).select("doc_id", S.basename_lower(F.col("path")).alias("name"))


@query("F3_norm_path", "SELECT doc_id, 'a/' || source || '/b' AS path FROM documents")
def f3(spark, d):
    return read(spark, d, "documents").select("doc_id", S.norm_path(F.concat(F.lit("./a//"), "source", F.lit("\\.\\b/"))).alias("path"))


@query("F4_segments", "SELECT doc_id, [lang, source] AS parts FROM documents")
def f4(spark, d):
    return paths(spark, d).select("doc_id", S.dir_segments(F.trim("path")).alias("parts"))


@query("F5_group_key", "SELECT doc_id, lang || '/' || source AS whole, lang AS top1, source AS tail1, lang || '/' || source AS tail0 FROM documents")
def f5(spark, d):
    p = F.trim("path")
    return paths(spark, d).select("doc_id", S.group_key(p).alias("whole"), S.group_key(p, top=1).alias("top1"), S.group_key(p, tail=1).alias("tail1"), S.group_key(p, tail=0).alias("tail0"))


@query("F6_folder_after", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Doc-' || doc_id || '.JPG' ELSE source END AS folder FROM documents")
def f6(spark, d):
    p = paths(spark, d).withColumn("path", F.trim("path"))
    marked = F.when(F.col("path").startswith("en/"), F.regexp_replace("path", "^en/[^/]*", "videos_sampled_1fps")).otherwise(F.col("path"))
    return p.select("doc_id", S.folder_after(marked, ["videos_subsampled_1fps", "videos_sampled_1fps"]).alias("folder"))


@query("F7_stem_extension", "SELECT doc_id, 'Doc-' || doc_id AS stem, '.JPG' AS ext FROM documents")
def f7(spark, d):
    return paths(spark, d).select("doc_id", S.stem(F.col("path")).alias("stem"), S.extension(F.col("path")).alias("ext"))


@query("F8_slugify", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_name), '[^a-zA-Z0-9._-]+', '-', 'g'), '-'), ''), 'chart') AS slug FROM part")
def f8(spark, d):
    return read(spark, d, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"))


@query("F9_ascii", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents")
def f9(spark, d):
    return read(spark, d, "documents").select("doc_id", S.ascii_filter(F.col("text")).alias("text"))


@query("F10_ascii_fold")
def f10(spark, d):
    return read(spark, d, "documents").select("doc_id", S.ascii_fold("text").alias("text"))


@query("F11_nfkc_spaces")
def f11(spark, d):
    return read(spark, d, "documents").select("doc_id", S.nfkc_spaces("text").alias("text"))


@query("F12_number_after_dash", "SELECT doc_id, doc_id::VARCHAR AS number, NULL::VARCHAR AS none FROM documents")
def f12(spark, d):
    return paths(spark, d).select("doc_id", S.number_after_dash(F.col("path")).alias("number"), S.number_after_dash(F.lit("none")).alias("none"))


@query("F13_number_before_image", "SELECT doc_id, doc_id::VARCHAR AS number FROM documents")
def f13(spark, d):
    return paths(spark, d).select("doc_id", S.number_before_image(F.col("path")).alias("number"))


@query("F14_book_page", "SELECT doc_id, doc_id::VARCHAR AS book, '7' AS page FROM documents")
def f14(spark, d):
    b = S.book_page(F.concat(F.lit("."), F.col("doc_id").cast("string"), F.lit("_page7.png")))
    return read(spark, d, "documents").select("doc_id", b["book"].alias("book"), b["page"].alias("page"))


@query("F15_prefix", "SELECT event_id, split_part(event_type || '_' || user_id, '_', 1) AS prefix FROM events")
def f15(spark, d):
    return read(spark, d, "events").select("event_id", S.prefix_before_underscore(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string"))).alias("prefix"))


@query("F16_answer_key", "SELECT conv_id, turn, rtrim(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~') AS key FROM conversations")
def f16(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.answer_key(F.col("text")).alias("key"))


@query("F17_yes_no_other", "SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer FROM labels")
def f17(spark, d):
    return read(spark, d, "labels").select("doc_id", S.yes_no_other(F.when(F.col("quality") == 1, " Yes ").otherwise("NO")).alias("answer"))


@query("F18_number", "SELECT p_partkey, p_retailprice AS number, NULL::DOUBLE AS none FROM part")
def f18(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", S.to_number(F.concat(F.col("p_retailprice").cast("string"), F.lit("%"))).alias("number"), S.to_number(F.col("p_name")).alias("none"))


@query("F19_fraction", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 1.0000001 THEN l_quantity ELSE l_quantity / 100 END AS fraction FROM lineitem")
def f19(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.fraction(F.col("l_quantity")).alias("fraction"))


@query("F20_crop", """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT *, array_to_string(w[21:28], ' ') AS tail FROM w)
SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(w[1:20], ' ') || ' ' || CASE WHEN instr(tail, '.') = 0 THEN tail ELSE substr(tail, 1, instr(tail, '.')) END END AS text FROM t""")
def f20(spark, d):
    return read(spark, d, "documents").select("doc_id", S.crop_words(F.col("text")).alias("text"))


@query("F21_title", "SELECT doc_id, 'Doc ' || doc_id AS title FROM documents")
def f21(spark, d):
    return paths(spark, d).select("doc_id", S.title_of(F.col("path")).alias("title"))


@query("F22_word_segments", "SELECT c_custkey, 'Dark Olive Green' AS name FROM customer")
def f22(spark, d):
    cut = S.segment_words(["dark", "olive", "green", "lighter", "light"])
    return read(spark, d, "customer").select("c_custkey", cut(F.lit("darkolivegreen")).alias("name"))


@query("F23_more_words", "SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN false ELSE len(regexp_split_to_array(trim(p_name), '\\s+')) > 1 END AS many FROM part")
def f23(spark, d):
    return read(spark, d, "part").select("p_partkey", S.more_words_than(F.col("p_name"), 1).alias("many"))


@query("F24_path_edit", "SELECT page_id, regexp_replace(html, 'href=\"/', 'href=\"https://example.org/', 'g') AS html FROM pages")
def f24(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace("html", 'href="/', 'href="https://example.org/').alias("html"))


@query("P8_prefix_case", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'chartqa' WHEN 1 THEN 'img' ELSE 'imgD' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'chartqa_csv_file_' || doc_id WHEN 1 THEN 'img' || doc_id ELSE 'imgD_' || doc_id || '_x' END AS prefix FROM documents")
def p8(spark, d):
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("chartqa_csv_file_"), i, F.lit("-a"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("img"), i, F.lit("_b"))).otherwise(F.concat(F.lit("imgD_"), i, F.lit("_x.png")))
    p = S.prefix_case(name)
    return read(spark, d, "documents").select("doc_id", p["kind"].alias("kind"), p["prefix"].alias("prefix")).filter("kind IS NOT NULL")


@query("P17_iou", "SELECT user_id, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 6) AS iou FROM (SELECT *, 200 - a AS b FROM (SELECT DISTINCT user_id, greatest(0, 10 - user_id % 12)::DOUBLE * greatest(0, 10 - user_id % 7)::DOUBLE AS a FROM events))")
def p17(spark, d):
    u = read(spark, d, "events").select("user_id").distinct()
    x, y = (F.col("user_id") % 12).cast("double"), (F.col("user_id") % 7).cast("double")
    one = F.array(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    return u.select("user_id", F.round(S.iou(one, F.array(x, y, x + 10, y + 10)), 6).alias("iou"))


@query("U6_stable_seed", "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UHUGEINT % 4294967295)::BIGINT AS seed FROM documents")
def u6(spark, d):
    return read(spark, d, "documents").select("doc_id", S.stable_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("X1_expiry", "SELECT event_id, epoch(ts) + user_id % 100 - epoch(TIMESTAMP '2024-01-01 00:00:00') < 60 AS expired, true AS unreadable FROM events")
def x1(spark, d):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ev = read(spark, d, "events")
    return ev.select("event_id", S.is_expired(F.col("ts").cast("string"), F.col("user_id") % 100, now).alias("expired"), S.is_expired(F.lit("?"), F.lit(5), now).alias("unreadable"))


@query("X3_luminance", "SELECT p_partkey, round(0.2126::DOUBLE * (p_size % 256) + 0.7152::DOUBLE * (p_size * 3 % 256) + 0.0722::DOUBLE * (p_size * 7 % 256), 6) AS y FROM part")
def x3(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", F.round(S.luminance(s % 256, s * 3 % 256, s * 7 % 256), 6).alias("y"))


@query("X6_floor_buckets", "SELECT c_custkey, floor(c_acctbal / 10)::BIGINT AS bucket FROM customer")
def x6(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 10).alias("bucket"))


@query("X7_suffixes", "SELECT DISTINCT source, s FROM (SELECT source, unnest(['a_' || lang || '_' || source, lang || '_' || source, source]) AS s FROM documents)")
def x7(spark, d):
    docs = read(spark, d, "documents").select("source", F.concat(F.lit("a_"), "lang", F.lit("_"), "source").alias("name")).distinct()
    return docs.select("source", F.explode(S.suffixes(F.col("name"))).alias("s")).distinct()


@query("R1_slug", "SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], 'chart') AS slug, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def r1(spark, d):
    return read(spark, d, "pages").select("page_id", U.slug(F.col("url")).alias("slug"), U.query_of(F.col("url")).alias("query"))


@query("R2_canonical_query", "SELECT page_id, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS query FROM pages")
def r2(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical_query(U.query_of(F.col("url"))).alias("query"))


@query("R3_export_url", "SELECT page_id, 'https://example.org/grapher/c' || page_id || '.svg?download-format=svg&tab=chart' AS url FROM pages")
def r3(spark, d):
    src = F.concat(F.lit("https://example.org/grapher/c"), F.col("page_id").cast("string"), F.lit(".png?tab=chart"))
    return read(spark, d, "pages").select("page_id", U.export_url(src, "svg").alias("url"))


@query("R4_filename", "WITH q AS (SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], 'chart') AS slug, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS q FROM pages) SELECT page_id, slug || '-' || CASE WHEN q = '' THEN 'base' ELSE substr(sha1(q), 1, 8) END || '.png' AS name FROM q")
def r4(spark, d):
    return read(spark, d, "pages").select("page_id", U.chart_filename(F.col("url"), "png").alias("name"))


@query("R5_attributes", "SELECT page_id, list_aggregate(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*\"([^\"]*)\"', 1), lambda x: trim(x)), 'count') AS n FROM pages")
def r5(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"'), 1)).cast("long").alias("n"))


@query("R5_anchor_parser")
def r5b(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(U.anchors("html", "url")).alias("url"))


@query("R6_data_links")
def r6(spark, d):
    return read(spark, d, "pages").select("page_id", U.data_links("html", "url").alias("links"))


@query("R7_addresses", "SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '(https?://data\\.example\\.org[^\\s\"''<>]*)', 1))) AS found FROM pages")
def r7(spark, d):
    return read(spark, d, "pages").select("page_id", U.addresses(F.col("html"), "data.example.org").alias("found"))


@query("R8_absolutize", "SELECT page_id, 'https://example.org/x/' || page_id AS url FROM pages")
def r8(spark, d):
    src = F.concat(F.lit("/x/"), F.col("page_id").cast("string"), F.lit("?a=1#top"))
    return read(spark, d, "pages").select("page_id", U.without_query(U.absolutize(src, "https://example.org")).alias("url"))


@query("R9_page_number", "SELECT page_id, 'https://example.org/l?a=1' || CASE WHEN page_id <= 1 THEN '' ELSE '&page=' || page_id END AS url FROM pages")
def r9(spark, d):
    return read(spark, d, "pages").select("page_id", U.page_number(F.lit("https://example.org/l?page=9&a=1"), F.col("page_id")).alias("url"))


@query("R10_api_url", "SELECT page_id, 'https://api.example.org/A,' || page_id || '/all?format=csvfilewithlabels&dimensionAtObservation=AllDimensions&startPeriod=2000' AS url FROM pages")
def r10(spark, d):
    return read(spark, d, "pages").select("page_id", U.api_url("https://api.example.org", F.lit("A"), F.col("page_id").cast("string"), "2000").alias("url"))


@query("P9_source_class", "SELECT page_id, CASE WHEN regexp_matches(lower(url), 'example\\.com') THEN 'com' WHEN regexp_matches(lower(url), 'example\\.org') THEN 'org' END AS class FROM pages")
def p9(spark, d):
    return read(spark, d, "pages").select("page_id", U.source_class([F.lit(None).cast("string"), F.col("url")], {"com": r"example\.com", "org": r"example\.org"}).alias("class"))


@query("P10_allowed", "SELECT min(page_id) AS page_id, split_part(regexp_extract(url, '^https?://([^/?#]*)', 1), '.', 1) AS host FROM pages WHERE regexp_matches(url, 'example\\.(com|org)') GROUP BY 2")
def p10(spark, d):
    from ..operators.sampling import first_of

    p = read(spark, d, "pages").withColumn("class", U.source_class([F.col("url")], {"com": r"example\.com", "org": r"example\.org"})).filter(F.col("class").isin("com", "org"))
    p = p.select("page_id", F.substring_index(F.regexp_extract("url", "^https?://([^/?#]*)", 1), ".", 1).alias("host"))
    return first_of(p, ["host"], ["page_id"])


@query("P14_content_urls", "SELECT page_id FROM pages WHERE starts_with(url, 'https://') AND NOT contains(url, '#') AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '\\.[a-zA-Z0-9]{2,4}$') AND NOT starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/fr/')")
def p14(spark, d):
    return read(spark, d, "pages").filter(U.is_content_url(F.col("url"), "https://", ["/fr/"])).select("page_id")


@query("P15_robots", "SELECT page_id FROM pages WHERE NOT starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/de/') AND NOT starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/es/')")
def p15(spark, d):
    path = F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("/"))
    rules = spark.createDataFrame([("/de/",), ("/es/",)], "prefix string")  # a site's rules, a few
    p = read(spark, d, "pages").withColumn("path", path)
    return p.join(F.broadcast(rules), F.col("path").startswith(F.col("prefix")), "left_anti").select("page_id")


@query("P16_base_view", "SELECT page_id FROM pages WHERE regexp_extract(url, '\\?([^#]*)', 1) = ''")
def p16(spark, d):
    return read(spark, d, "pages").filter(U.canonical_query(U.query_of(F.col("url"))) == "").select("page_id")


@query("H1_word_lines", "SELECT doc_id, replace(text, ' ', chr(10)) AS text FROM documents")
def h1(spark, d):
    return read(spark, d, "documents").select("doc_id", layout.word_lines(F.col("text")).alias("text"))


@query("H1_phrase_lines")
def h1b(spark, d):
    return read(spark, d, "documents").select("doc_id", layout.phrase_lines()("text", F.col("doc_id").cast("string")).alias("text"))


@query("H1_char_spread")
def h1c(spark, d):
    return read(spark, d, "documents").select("doc_id", layout.char_spread()("text", F.col("doc_id").cast("string")).alias("text"))


@query("H2_inner_spaces")
def h2(spark, d):
    return read(spark, d, "documents").select("doc_id", layout.inner_spaces()("text", F.col("doc_id").cast("string")).alias("text"))


@query("H3_expected_text", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def h3(spark, d):
    return read(spark, d, "benchmark").select("item_id", layout.expected_text(F.col("text"), F.regexp_replace("text", " ", "")).alias("text"))


@query("H4_wrap")
def h4(spark, d):
    return read(spark, d, "benchmark").select("item_id", layout.wrap(F.col("text"), 40).alias("lines"))


@query("H6_without_repeats")
def h6(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", layout.without_repeats("text").alias("text"))


@query("S18_paragraphs", "SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\\n'), lambda x: trim(x))) AS p FROM documents) WHERE p <> '' AND len(regexp_split_to_array(p, '[ \\t\\n\\x0B\\f\\r]+')) BETWEEN 15 AND 50")
def s18(spark, d):
    doubled = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return read(spark, d, "documents").select("doc_id", F.explode(layout.paragraphs(doubled)).alias("paragraph"))
