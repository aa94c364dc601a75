"""Registered queries of the smaller functions and of the store's table steps, each beside its SQL.

They are registered with the others by ``queries``; inputs are made from whole tables by the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltloom.functions import arrays, dates, text, urls
from feltloom.operators import announce, history, projection, sinks
from feltloom.plans.queries import query, table

_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}\p{{Nd}}]+', '', 'g')"


@query(rf"""SELECT p_partkey, {_FOLD.format("p_brand")} || ':' || {_FOLD.format("p_name")} AS slug, trim(' ,' || p_name || ' ;:', ' ,;:.') AS cleaned FROM part""")
def prose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.prose_slug("p_brand", "p_name").alias("slug"), text.clean_name(F.concat(F.lit(" ,"), "p_name", F.lit(" ;:"))).alias("cleaned"))


@query(rf"""SELECT p_partkey, list_distinct([{_FOLD.format("p_brand")} || ':' || {_FOLD.format("t")} FOR t IN
        [p_name || ' LP (' || p_type || ') [' || p_size || ']', p_name || ' LP (' || p_type || ')', p_name || ' LP', p_name]]).list_sort() AS names FROM part""")
def edition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title loses its edition marks one at a time; each step is a name."""
    title = F.concat("p_name", F.lit(" LP ("), "p_type", F.lit(") ["), F.col("p_size").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(text.album_names("p_brand", title)).alias("names"))


@query(r"""SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || chr(10) || p_brand AS tidy, p_name || chr(10) || p_type || chr(10) || p_brand AS unix,
    len(string_split(p_name || chr(13) || chr(10) || p_type || chr(10) || p_brand, chr(10))) AS lines FROM part""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    loose = F.concat(F.lit("\n  "), F.regexp_replace("p_name", " ", "  \t"), F.lit("\r\n"), "p_type", F.lit(" \r\r\n\n"), "p_brand", F.lit("\n\n"))
    unix = F.concat("p_name", F.lit("\r\n"), "p_type", F.lit("\r"), "p_brand")
    plain = text.plain_lines(F.concat("p_name", F.lit("\r\n"), "p_type", F.lit("\n"), "p_brand"))
    return rows.select("p_partkey", text.tidy_text(loose).alias("tidy"), text.unix_lines(unix).alias("unix"), F.size(plain).cast("bigint").alias("lines"))


@query(r"""SELECT p_partkey, p_name || ', (' || p_type || ')' AS tidy, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN ' stars' ELSE ' Star' END AS stars,
    p_type AS labelled, p_name AS thread FROM part""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation, ratings, labelled fields and thread names without a marker."""
    rows, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    rating = F.when(F.col("p_size") % 2 == 0, size).otherwise(F.concat(size, F.lit(" Star")))
    loose = F.concat("p_name", F.lit(" ,  ( "), "p_type", F.lit(" )"))
    return rows.select(
        "p_partkey", text.tidy_punctuation(loose).alias("tidy"), text.stars(rating).alias("stars"), text.labelled(F.concat(F.lit(" Director: "), "p_type"), "director").alias("labelled"), text.strip_marker(F.concat(F.lit("[Official] - "), "p_name"), "[official]").alias("thread")
    )


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey > 0 AND o_orderstatus <> 'F' THEN CAST(o_orderkey AS VARCHAR) END AS id,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 7 END AS major FROM orders""")
def id_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical positive ids (no leading zero) and version numbers."""
    key = F.col("o_orderkey").cast("string")
    version = F.concat(F.when(F.col("o_orderstatus") == "P", "w").otherwise("v"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".0."), key)
    padded = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("0"), key)).otherwise(key)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.positive_id(padded).alias("id"), text.version_parts(version)["major"].cast("bigint").alias("major"))


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^/]+') AS web, regexp_replace(url, '[?#].*$', '') || '?page=' || CAST(page_id AS VARCHAR) AS next FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web URLs; the next page's by its query parameter."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", urls.is_web("url").alias("web"), urls.with_query(bare, "page", F.col("page_id")).alias("next"))


@query(r"""WITH o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)
    SELECT l_orderkey, a = range(1, 4) AS same, list_filter(flags, lambda m: m IN ('A', 'R')) AS kept FROM o""")
def set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set equality whatever the order, and the members of an allowlist in the order they came."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    wanted = F.array(*[F.lit(i) for i in (3, 1, 2)]).cast(rows.schema["a"].dataType)
    return rows.select("l_orderkey", arrays.same_set(F.col("a"), wanted).alias("same"), arrays.kept_in_order(F.col("flags"), ["R", "A"]).alias("kept"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of orders as stored and as new: of some customers both, of some one alone."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("guid"), F.col("o_orderstatus").alias("status"))
    return rows.where("status <> 'P'").withColumn("at", F.lit(1)), rows.where("status <> 'F'").withColumn("at", F.lit(2))


_STORED = """o AS (SELECT o_custkey AS source_id, CAST(o_orderkey AS VARCHAR) AS guid, o_orderstatus AS status FROM orders),
    old AS (SELECT *, 1 AS at FROM o WHERE status <> 'P'), new AS (SELECT *, 2 AS at FROM o WHERE status <> 'F')"""


@query(f"""WITH {_STORED} SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new""")
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot: all rows of the polled sources give way."""
    old, new = _stored(spark, sf_dir)
    return sinks.replace_source(old, new, new.select("source_id"))


@query(f"""WITH {_STORED} SELECT coalesce(n.source_id, o.source_id) AS source_id, guid, coalesce(n.status, o.status) AS status, coalesce(n.at, o.at) AS at FROM old o FULL JOIN new n USING (guid)""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.upsert(*_stored(spark, sf_dir), ["guid"])


@query(f"""WITH {_STORED} SELECT coalesce(o.source_id, n.source_id) AS source_id, guid, coalesce(o.status, n.status) AS status, coalesce(o.at, n.at) AS at FROM old o FULL JOIN new n USING (guid)""")
def store_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.insert_ignore(*_stored(spark, sf_dir), ["guid"])


@query(f"""WITH {_STORED} SELECT source_id, guid, min("at") AS "at" FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY 1, 2""")
def store_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (t.drop("status") for t in _stored(spark, sf_dir))
    return sinks.keep_earliest(old, new, ["source_id", "guid"], "at")


@query(f"""WITH {_STORED} SELECT source_id, guid FROM old UNION ALL SELECT source_id, guid FROM new WHERE status = 'P'""")
def store_insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert that would fail on a key that is there."""
    old, new = (t.select("source_id", "guid", "status") for t in _stored(spark, sf_dir))
    return sinks.insert_unique(old.drop("status"), new.where("status = 'P'").drop("status"), ["source_id", "guid"])


@query(f"""WITH {_STORED} SELECT source_id, guid, guid IN (SELECT guid FROM new) AS live FROM old""")
def snapshot_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items beside the live set."""
    old, new = _stored(spark, sf_dir)
    return history.with_live(old.select("source_id", "guid"), new.select("source_id", "guid")).select("source_id", "guid", "live")


@query("""WITH o AS (SELECT o_custkey AS source_id, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) // 30 AS epoch, o_orderkey % 12 AS k, o_orderdate AS pub_date FROM orders),
    obs AS (SELECT source_id, epoch, 'g' || CAST(k AS VARCHAR) AS guid, DATE '2020-01-01' + CAST(k % 5 AS INTEGER) AS pub_date FROM o),
    merged AS (SELECT DISTINCT source_id, guid, pub_date FROM obs), last AS (SELECT source_id, max(epoch) AS epoch FROM obs GROUP BY 1),
    live AS (SELECT DISTINCT source_id, guid FROM obs JOIN last USING (source_id, epoch)),
    r AS (SELECT m.source_id, m.guid, m.pub_date, l.guid IS NOT NULL AS live, row_number() OVER (PARTITION BY m.source_id ORDER BY m.pub_date DESC, m.guid) AS rank FROM merged m LEFT JOIN live l ON m.source_id = l.source_id AND m.guid = l.guid)
    SELECT source_id, guid, strftime(pub_date, '%Y-%m-%d') AS pub_date, live FROM r WHERE live OR rank <= 4""")
def history_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, live set and pruning of all epochs together."""
    k = F.col("o_orderkey") % 12
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 5).cast("int"))
    epoch = F.floor(F.datediff("o_orderdate", F.lit("1970-01-01")) / 30)
    observed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), epoch.alias("epoch"), F.concat(F.lit("g"), k.cast("string")).alias("guid"), day.alias("pub_date"))
    return history.history(observed, 4).select("source_id", "guid", F.date_format("pub_date", "yyyy-MM-dd").alias("pub_date"), "live")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low price' END AS reason FROM orders""")
def quarantine_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready rows and rejects of one quarantine, together all rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("guid"), "o_orderkey", "o_totalprice")
    ready, rejects = announce.quarantine(rows, F.col("o_totalprice") < 50000, "price", F.lit("low price"))
    return ready.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(rejects.select(F.col("guid").cast("bigint").alias("o_orderkey"), "reason"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
    CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 ELSE 0 END AS wait_s FROM orders""")
def loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the first format that fits, and Retry-After headers: numbers count, the past and the unreadable do not."""
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    given = F.when(status == "F", F.date_format(day, "yyyy-MM-dd")).when(status == "O", F.date_format(day, "dd/MM/yyyy")).otherwise("soon")
    header = F.when(status == "F", (F.col("o_orderkey") % 100).cast("string")).when(status == "O", F.lit("-5")).otherwise("later")
    parsed = F.date_format(dates.parse_first(given, "yyyy-MM-dd", "dd/MM/yyyy"), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("parsed"), dates.retry_after_seconds(header, day).alias("wait_s"))


@query("""SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY END, o_orderdate + INTERVAL 2 DAY), '%Y-%m-%d') AS pub_date,
    o_orderstatus = 'P' AS pending FROM orders""")
def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's own date, else that of its page, else when it was first seen."""
    rows = table(spark, sf_dir, "orders").select(F.lit("s").alias("source_id"), F.col("o_orderkey").cast("string").alias("guid"), "o_orderkey", "o_orderdate", "o_orderstatus")
    keys = ["source_id", "guid"]
    items = rows.withColumn("pub_date", F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate END"))
    seen = rows.select(*keys, F.expr("o_orderdate + INTERVAL 2 DAY").alias("first_seen"))
    own = rows.where("o_orderstatus = 'O'").select(*keys, F.expr("o_orderdate + INTERVAL 1 DAY").alias("page_date"))
    return projection.dated(items, seen, keys, own).select("o_orderkey", F.date_format("pub_date", "yyyy-MM-dd").alias("pub_date"), "pending")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'""")
def minus_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an announcement poll goes on with once the unreadable items are out."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    ready, _ = announce.quarantine(rows, F.col("o_orderstatus") == "P", "metadata", F.lit("unreadable"))
    return ready.select("o_orderkey")

_POLLS = """SELECT l_suppkey AS source_id, CAST(l_partkey AS VARCHAR) AS guid, 12 * year(l_shipdate) + month(l_shipdate) AS epoch, date_trunc('month', l_shipdate)::DATE AS today,
    bool_or(l_returnflag <> 'N') AS readable, bool_or(l_linestatus = 'O') AS release, min(l_shipdate::DATE + CAST(l_quantity AS INT)) AS first_day
    FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL"""


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of suppliers as monthly polls: parts are items, and a return says that the item's page could be read."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    month = (12 * F.year("l_shipdate") + F.month("l_shipdate")).alias("epoch")
    day = F.to_date("l_shipdate")
    return lines.groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").cast("string").alias("guid"), month, F.trunc(day, "MM").alias("today")).agg(
        F.bool_or(F.col("l_returnflag") != "N").alias("readable"), F.bool_or(F.col("l_linestatus") == "O").alias("release"), F.min(F.date_add(day, F.col("l_quantity").cast("int"))).alias("first_day")
    )


@query(f"""
    WITH p AS ({_POLLS}), b AS (SELECT source_id, min(epoch) AS baseline FROM p GROUP BY 1),
    n AS (SELECT p.* FROM p JOIN b USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.source_id = p.source_id AND q.guid = p.guid AND q.epoch = b.baseline)),
    d AS (SELECT source_id, guid, min(epoch) FILTER (WHERE readable) AS decided FROM n GROUP BY 1, 2)
    SELECT n.source_id, n.guid, CAST(n.epoch AS INT) AS epoch, CASE WHEN epoch IS DISTINCT FROM decided THEN 'waits' WHEN release THEN 'announced' ELSE 'remembered' END AS outcome
    FROM n JOIN d ON n.source_id = d.source_id AND n.guid = d.guid WHERE decided IS NULL OR epoch <= decided""")
def announce_read_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that wait until a poll can read their page: then announced, or remembered silently, once."""
    polled = _polls(spark, sf_dir)
    begins = polled.groupBy("source_id").agg(F.min("epoch").alias("epoch"))
    silent = polled.join(begins, ["source_id", "epoch"], "left_semi").select("source_id", "guid")
    decided, waiting = announce.first_ready(announce.unannounced(polled, silent, ["source_id", "guid"]), "readable")
    outcome = F.when(F.col("release"), "announced").otherwise("remembered").alias("outcome")
    return decided.select("source_id", "guid", "epoch", outcome).unionByName(waiting.select("source_id", "guid", "epoch", F.lit("waits").alias("outcome")))


@query(f"""
    WITH p AS ({_POLLS}), l AS (SELECT source_id, max(epoch) AS last FROM p GROUP BY 1),
    r AS (SELECT *, readable AND first_day <= today + 14 AS ready FROM p), d AS (SELECT source_id, guid, min(epoch) FILTER (WHERE ready) AS decided FROM r GROUP BY 1, 2)
    SELECT r.source_id, r.guid, CAST(r.epoch AS INT) AS epoch, CASE WHEN epoch = decided THEN 'announced' WHEN NOT readable THEN 'unread' WHEN epoch = last THEN 'held' ELSE 'passed' END AS outcome
    FROM r JOIN d ON r.source_id = d.source_id AND r.guid = d.guid JOIN l ON r.source_id = l.source_id WHERE decided IS NULL OR epoch <= decided""")
def announce_window_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items announced at the first poll that reads a near first day; what the last poll leaves is held."""
    polled = _polls(spark, sf_dir).withColumn("ready", F.col("readable") & (F.col("first_day") <= F.date_add("today", 14)))
    decided, waiting = announce.first_ready(polled, "ready")
    last = polled.groupBy("source_id").agg(F.max("epoch").alias("last"))
    outcome = F.when(~F.col("readable"), "unread").when(F.col("epoch") == F.col("last"), "held").otherwise("passed").alias("outcome")
    return decided.select("source_id", "guid", "epoch", F.lit("announced").alias("outcome")).unionByName(waiting.join(last, "source_id").select("source_id", "guid", "epoch", outcome))


@query(f"""
    WITH p AS ({_POLLS}), l AS (SELECT source_id, max(epoch) AS epoch FROM p GROUP BY 1), u AS (SELECT source_id, guid, count(DISTINCT epoch) AS tries, max(epoch) AS epoch FROM p WHERE NOT readable GROUP BY 1, 2)
    SELECT u.source_id, u.guid, 'https://shop/' || u.guid AS url, CAST(tries + CASE WHEN CAST(u.guid AS BIGINT) % 2 = 0 THEN 3 ELSE 0 END AS INT) AS attempts FROM u JOIN l ON u.source_id = l.source_id AND u.epoch = l.epoch""")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of item pages after all polls, on top of one from before that had every second part three times."""
    polled = _polls(spark, sf_dir)
    wanted = polled.where(~F.col("readable")).select("source_id", "epoch", "guid", F.lit("identity").alias("purpose"), F.concat(F.lit("https://shop/"), "guid").alias("url"))
    before = polled.select("source_id", "guid").distinct().where("cast(guid as bigint) % 2 = 0").select("source_id", "guid", F.lit("identity").alias("purpose"), F.lit("").alias("url"), F.lit(3).alias("attempts"), F.lit(0).alias("epoch"))
    return announce.pending_queue(before, wanted, polled).select("source_id", "guid", "url", "attempts")


@query("""
    WITH s AS (SELECT vendor_id AS source_id, strftime(shipped_at, '%Y%m%d')::INT AS epoch, item_id AS number FROM sale_lines WHERE vendor_id IS NOT NULL AND shipped_at IS NOT NULL AND item_id IS NOT NULL),
    i AS (SELECT source_id, min(epoch) AS epoch, max(number) AS initial FROM s SEMI JOIN (SELECT source_id, min(epoch) AS epoch FROM s GROUP BY 1) USING (source_id, epoch) GROUP BY 1),
    k AS (SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 5 ELSE initial END AS initial, CASE WHEN source_id % 3 = 0 THEN NULL ELSE epoch END AS baseline FROM i)
    SELECT s.source_id, s.number, min(s.epoch) AS epoch FROM s JOIN k USING (source_id) GROUP BY s.source_id, s.number, initial, baseline HAVING number > initial OR number = initial AND min(s.epoch) = baseline""")
def announce_numbers_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of vendors by number, where every third vendor was polled before and began at five."""
    lines = table(spark, sf_dir, "sale_lines").where("vendor_id is not null and shipped_at is not null and item_id is not null")
    seen = lines.select(F.col("vendor_id").alias("source_id"), F.date_format("shipped_at", "yyyyMMdd").cast("int").alias("epoch"), F.col("item_id").alias("number"))
    before = seen.select("source_id").distinct().where("source_id % 3 = 0").withColumn("initial", F.lit(5).cast("bigint"))
    return announce.announce_numbers(seen, before)
