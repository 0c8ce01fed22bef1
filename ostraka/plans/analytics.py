"""Queries of lookups, aggregates, windows, order, sets, data quality and duplicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sortkeys, text
from ..operators import duplicates, lookups, windows
from .base import query, read


# Lookups


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def lookup_nested(spark, sf_dir):
    nation = lookups.attach(read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), read(spark, sf_dir, "region"), ["r_regionkey"], "region")
    found = lookups.attach(read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), nation, ["n_nationkey"], "nation")
    return found.select("c_custkey", "nation.n_name", "nation.region.r_name")


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || p_brand, ',' ORDER BY l_linenumber, l_partkey) AS refs
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def regroup_refs(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    orders = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("refs"))
    found = lookups.regroup(orders, ["l_orderkey"], "refs", read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey", "part")
    return found.select("l_orderkey", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["item"]["l_linenumber"].cast("string"), r["part"]["p_brand"])), ",").alias("refs"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R') AS returned FROM lineitem a")
def lookup_composite(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    found = lookups.exists_flag(items, items.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "returned")
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "returned")


@query("SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey")
def lookup_first_group(spark, sf_dir):
    groups = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_partkey")).alias("parts"))
    return lookups.member_groups(groups, "parts", "l_partkey", [F.col("l_orderkey")]).select("l_partkey", F.col("l_orderkey").alias("first_order"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_exists(spark, sf_dir):
    large = read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return read(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def implicit_child(spark, sf_dir):
    return lookups.lowest_child(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate"], ["o_orderkey"])


@query("SELECT n_name, count(*) AS orders, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def two_level_lookup(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    joined = read(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_discount > 0.08)")
def criteria_semi(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    ids = read(spark, sf_dir, "lineitem").where("l_discount > 0.08").join(urgent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("l_suppkey")
    return read(spark, sf_dir, "supplier").join(ids, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


# Aggregates


@query("SELECT count(*) AS total, sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS long_ones, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS english, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents")
def statistics(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"), F.count_if(F.col("lang") == "en").alias("english"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


_TOK = r"""T AS (SELECT * FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS token FROM documents) WHERE token <> '')"""


@query(f"WITH {_TOK} SELECT token, count(*) AS n FROM (SELECT token FROM T UNION ALL SELECT token FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS token FROM conversations) WHERE token <> '') GROUP BY token")
def lemma_counts(spark, sf_dir):
    words = F.explode(F.flatten(text.token_lines(F.col("text")))).alias("token")
    both = read(spark, sf_dir, "documents").select(words).unionByName(read(spark, sf_dir, "conversations").select(words))
    return both.groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_TOK}, C AS (SELECT substr(token, 1, 2) AS form, token, count(*) AS n FROM T GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, encode(token)) AS k FROM C) SELECT form, token, n FROM R WHERE k = 1")
def autofill(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.flatten(text.token_lines(F.col("text")))).alias("token"))
    counts = words.groupBy(F.substring("token", 1, 2).alias("form"), "token").agg(F.count("*").alias("n"))
    return counts.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("m"), "token")).alias("best")).select("form", "best.token", (-F.col("best.m")).alias("n"))


@query("SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS latest FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 ORDER BY latest DESC, user_id LIMIT 50")
def latest_records(spark, sf_dir):
    latest = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(latest.alias("latest")).where("latest is not null").orderBy(F.desc("latest"), "user_id").limit(50)


@query("""SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id
    HAVING count(*) FILTER (event_type = 'purchase') > 0 AND coalesce(min(ts) FILTER (event_type = 'view'), TIMESTAMP '2999-01-01') > min(ts) FILTER (event_type = 'purchase')""")
def needs_revision(spark, sf_dir):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    found = read(spark, sf_dir, "events").groupBy("user_id").agg(first("purchase").alias("first_purchase"), first("view").alias("first_view"))
    return found.where("first_purchase is not null and (first_view is null or first_view > first_purchase)").select("user_id", "first_purchase")


@query("SELECT l_suppkey, CAST(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 99 END) AS INTEGER) AS least FROM lineitem GROUP BY l_suppkey")
def conditional_min(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(99)).alias("least"))


@query("SELECT p_brand, string_agg(p_size, ',' ORDER BY p_size) AS sizes FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def text_sets(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), ",").alias("sizes"))


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_combos(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT md5(text) AS value, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_groups(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("value")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT floor(CAST(l_discount * 100 AS INTEGER) / 10.0) / 10 AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    score = F.round(F.col("l_discount") * 100).cast("int") / 100.0
    return read(spark, sf_dir, "lineitem").groupBy(duplicates.histogram(score).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS mean_price FROM orders")
def audit_summary(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey DESC) AS n FROM part) WHERE n = 1")
def canonical_member(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_size", "p_partkey")).alias("p_partkey"))


@query(r"""SELECT key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '"([a-z_]+)":', 1)) AS key FROM events UNION ALL SELECT event_type FROM events) GROUP BY key""")
def usage_counts(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    keys = events.select(F.explode(F.regexp_extract_all("props", F.lit('"([a-z_]+)":'), 1)).alias("key")).unionAll(events.select("event_type"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


# Windows


@query("""SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous,
    coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def pager(spark, sf_dir):
    return windows.ring(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "next")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n <= 10 ORDER BY c_mktsegment, c_custkey LIMIT 40")
def top_per_group(spark, sf_dir):
    return windows.top_per_group(read(spark, sf_dir, "customer"), "c_mktsegment", [F.col("c_custkey")], 10, 40, [F.col("c_mktsegment"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey")


@query("SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN value <= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh FROM events)")
def line_segments(spark, sf_dir):
    return windows.segments(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "segment")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def running_label(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return windows.carried(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query("""SELECT l_orderkey, l_linenumber, 'Word-' || CAST(CASE WHEN l_linenumber = 3 THEN 3 ELSE coalesce(max(CASE WHEN l_linenumber = 3 THEN 3 END) OVER (PARTITION BY l_orderkey), 0)
    + count(*) FILTER (l_linenumber <> 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS word_id FROM lineitem""")
def word_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    taken = F.when(F.col("l_linenumber") == 3, F.lit(3).cast("long"))
    return windows.numbered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], taken, "word_id", "Word-").select("l_orderkey", "l_linenumber", "word_id")


# Order


@query("""SELECT source, min(doc_id) AS first_id, lpad(substr(source, 4), 12, '0') AS padded FROM documents GROUP BY source""")
def natural_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"))
    return rows.withColumn("padded", F.substring(sortkeys.natural_key(F.col("source")), 4, 12)).orderBy(sortkeys.natural_key(F.col("source")))


_PREFIXES = (*sortkeys.PREFIX_ORDER, "k", "Q", "1903")


@query(f"""SELECT prefix, number, row_number() OVER (ORDER BY coalesce(list_position({list(sortkeys.PREFIX_ORDER)[:5]}, prefix), list_position({list(sortkeys.PREFIX_ORDER)[5:]}, prefix) + 6, CASE prefix WHEN '1903' THEN 6 ELSE 16 END), prefix, number) AS place
    FROM (SELECT DISTINCT {list(_PREFIXES)}[doc_id % {len(_PREFIXES)} + 1] AS prefix, doc_id AS number FROM documents)""")
def museum_sort(spark, sf_dir):
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("doc_id") % len(_PREFIXES)).cast("int"))
    rows = read(spark, sf_dir, "documents").select(prefix.alias("prefix"), F.col("doc_id").alias("number")).distinct()
    key = sortkeys.museum_key(F.col("prefix"), F.col("number").cast("string"), F.lit(""))
    return windows.placed(rows, key, "place")


@query("SELECT doc_id, CASE WHEN lower(source) = 'src1' THEN 0 WHEN starts_with(lower(source), 'src1') THEN 1 WHEN contains(lower(source), '1') THEN 2 ELSE 6 END AS rank FROM documents")
def relevance_rank(spark, sf_dir):
    low = F.lower("source")
    rank = F.when(low == "src1", 0).when(low.startswith("src1"), 1).when(low.contains("1"), 2).otherwise(6)
    return read(spark, sf_dir, "documents").select("doc_id", rank.alias("rank")).orderBy("rank", "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 101")
def keyset_page(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderkey > 5000").orderBy("o_orderkey").limit(101).select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_partkey FROM part WHERE starts_with(lower(p_name), 'b') ORDER BY length(p_name), p_name, p_partkey LIMIT 15")
def shortest_prefix(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.lower("p_name").startswith("b")).orderBy(F.char_length("p_name"), "p_name", "p_partkey").limit(15).select("p_name", "p_partkey")


# Sets


@query("SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY kind) AS n FROM (SELECT p_partkey AS id, 0 AS kind FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_brand = 'Brand#13' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_retailprice > 1500)) WHERE n = 1")
def priority_union(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    found = [part.where(c).select("id", F.lit(k).alias("kind")) for k, c in enumerate(("p_size = 7", "p_brand = 'Brand#13'", "p_retailprice > 1500"))]
    return found[0].unionAll(found[1]).unionAll(found[2]).groupBy("id").agg(F.min("kind").alias("kind"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(a.p_size AS INTEGER) AS a_value, CAST(b.p_size AS INTEGER) AS b_value FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 2 WHERE a.p_brand = b.p_brand")
def range_neighbours(spark, sf_dir):
    return lookups.near_values(read(spark, sf_dir, "part"), "p_partkey", "p_size", 2, "p_brand")


@query("""WITH RECURSIVE R AS (SELECT p_partkey AS id, p_partkey AS target, 0 AS hops FROM part UNION ALL
    SELECT R.id, CAST(R.target / 3 AS BIGINT), R.hops + 1 FROM R WHERE R.target % 3 = 0 AND R.target > 0)
    SELECT id, CASE WHEN max(hops) <= 5 THEN arg_max(target, hops) END AS target, CAST(least(max(hops), 6) AS INTEGER) AS hops FROM R GROUP BY id""")
def redirect_chase(spark, sf_dir):
    links = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") > 0), (F.col("p_partkey") / 3).cast("long")).alias("redirect"))
    return lookups.chase(links, links)


@query("SELECT a.w AS word, count(DISTINCT b.w) AS composites FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) a JOIN (SELECT DISTINCT p_name AS w FROM part) b ON list_contains(string_split(b.w, ' '), a.w) AND a.w <> b.w GROUP BY a.w")
def composite_match(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    parts = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).where("word <> name")
    return parts.groupBy("word").agg(F.count_distinct("name").alias("composites"))


# Data quality


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicates(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dq_orphans(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id").distinct()


@query("""WITH E AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) + 1 AS e FROM events)
    SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM E a JOIN E b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e""")
def dq_interval_overlap(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("s"), (F.floor("value") + 1).alias("e"))
    places = rows.select("user_id", "event_id", F.explode(F.sequence("s", "e")).alias("at"))
    left, right = places.withColumnRenamed("event_id", "a"), places.withColumnRenamed("event_id", "b")
    return left.join(right, ["user_id", "at"]).where("a < b").select("user_id", "a", "b").distinct()


@query("""SELECT doc_id, line_index FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_index FROM documents) WHERE contains(line, '!!')""")
def dq_invalid_lines(spark, sf_dir):
    return text.lines(read(spark, sf_dir, "documents")).where(F.contains("line", F.lit("!!"))).select("doc_id", "line_index")


# Duplicates


@query("""WITH K AS (SELECT p_partkey AS id, 'brand_size' AS kind, p_brand || '|' || p_size AS key FROM part UNION ALL SELECT p_partkey, 'name', substr(lower(p_name), 1, 20) FROM part),
    S AS (SELECT kind, key FROM K GROUP BY ALL HAVING count(*) BETWEEN 2 AND 250) SELECT kind, key, id FROM K JOIN S USING (kind, key)""")
def dup_blocks(spark, sf_dir):
    keys = {"brand_size": F.concat_ws("|", "p_brand", F.col("p_size").cast("string")), "name": F.substring(F.lower("p_name"), 1, 20)}
    return duplicates.blocks(read(spark, sf_dir, "part"), "p_partkey", keys).select("kind", "key", "id")


_PAIRS = """K AS (SELECT p_partkey AS id, p_brand || '|' || p_size AS key FROM part), S AS (SELECT key FROM K GROUP BY key HAVING count(*) BETWEEN 2 AND 250),
    P AS (SELECT DISTINCT x.id AS a, y.id AS b FROM K x JOIN S USING (key) JOIN K y USING (key) WHERE x.id < y.id),
    W AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part), N AS (SELECT id, count(*) AS n FROM W GROUP BY id),
    I AS (SELECT a, b, count(y.w) AS n FROM P JOIN W x ON x.id = a LEFT JOIN W y ON y.id = b AND y.w = x.w GROUP BY a, b),
    J AS (SELECT a, b, I.n / (x.n + y.n - I.n) AS score FROM I JOIN N x ON x.id = a JOIN N y ON y.id = b)"""


def _scored(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    found = duplicates.pairs(duplicates.blocks(part, "p_partkey", {"brand_size": F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))}))
    words = part.select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    left, right = (words.select(F.col("p_partkey").alias(k), F.col("w").alias(f"w{k}")) for k in ("a", "b"))
    return found.join(left, "a").join(right, "b").select("a", "b", duplicates.jaccard(F.col("wa"), F.col("wb")).alias("score"))


@query(f"WITH {_PAIRS} SELECT a, b, round(score, 4) AS score FROM J WHERE score >= 0.25")
def dup_pairs(spark, sf_dir):
    return _scored(spark, sf_dir).where("score >= 0.25").select("a", "b", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE {_PAIRS}, E AS (SELECT a, b FROM J WHERE score >= 0.4), U AS (SELECT a, b FROM E UNION SELECT b, a FROM E),
    R AS (SELECT a AS id, a AS node FROM U UNION SELECT R.id, U.b FROM R JOIN U ON U.a = R.node) SELECT id, min(node) AS cluster FROM R GROUP BY id""")
def dup_clusters(spark, sf_dir):
    return duplicates.clusters(_scored(spark, sf_dir).where("score >= 0.4"))
