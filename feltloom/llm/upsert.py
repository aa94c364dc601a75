"""Keyed upserts into a sorted Parquet table by copy on write: only files whose rows change are written again.

The table is a folder of files, each a range of keys. Where they begin is found by exact splitters (every M-th key,
from histograms, nothing is sorted as a whole); the splitters are the partitioner that deals rows to files and the index that
finds a key's file. A batch of changes keeps one winner a key (a partial maximum, so a key of a third of all
changes costs a row a task), is dealt by that index, sorted within its range, and meets the file's rows there. A first pass
finds out which files differ and how many rows they end with, the driver lays out the new files from these few numbers (their
count is bounded by rows / M), and a second pass writes them. New files are written aside, renamed into the folder, named in
``_manifest.json`` (published by rename: the commit) and then the replaced ones are deleted; readers go by the manifest.

Defined results: rows and changes without a key are left out; rows that repeat a key stay together in one file (which
then holds more than M rows) and take a change alike; of changes with equal order fields the greatest by all
fields wins, nulls lowest. An empty table has no files, so there is no home and changes to it are ignored.
Columns are carried whatever their names; the key must be an integer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feltloom.llm.common import importable, kept_path, write_shared
from feltloom.llm.files import Files
from feltloom.llm.splitters import exact_splitters, range_of

MANIFEST = "_manifest.json"


@dataclass
class File:
    name: str
    first: int
    rewritten: bool = False


@dataclass
class Table:
    """What a manifest says: the key, rows of a file at most, commits so far, the files in order of their keys."""

    key: str
    every: int
    commits: int
    files: list[File]


def read_manifest(spark: SparkSession, folder: str) -> Table:
    raw = json.loads(Files(spark).read(f"{folder}/{MANIFEST}"))
    return Table(raw["key"], raw["every"], raw["commits"], [File(**f) for f in raw["files"]])


def _publish(spark: SparkSession, folder: str, table: Table) -> None:
    Files(spark).publish(f"{folder}/{MANIFEST}", json.dumps(asdict(table)))


def _write_parts(dealt: DataFrame, folder: str, prefix: str) -> dict[int, str]:
    """Write one file a partition aside, then rename them into the folder; the names by partition."""
    spark, aside = dealt.sparkSession, f"{folder}/_write-{uuid.uuid4().hex}"
    dealt.write.parquet(aside)
    files, names = Files(spark), {}
    for name in files.names(aside):
        if name.startswith("part-"):
            number = int(name.split("-")[1])
            names[number] = f"{prefix}-{number:05d}.parquet"
            files.move(f"{aside}/{name}", f"{folder}/{names[number]}")
    files.delete(aside)
    return names


def write_table(rows: DataFrame, key: str, every: int, folder: str) -> Table:
    """Start a table: files of ``every`` rows in order of the key, the last with the rest."""
    spark = rows.sparkSession
    importable(spark)
    Files(spark).make(folder)
    keyed = rows.where(F.col(key).isNotNull())
    firsts = exact_splitters(keyed.select(F.col(key).cast("long").alias("key")), every)
    files = []
    if firsts:
        dealt = keyed.repartitionById(len(firsts), range_of(F.col(key).cast("long"), firsts)).sortWithinPartitions(key)
        names = _write_parts(dealt, folder, "c0")
        files = [File(names[i], firsts[i]) for i in sorted(names)]
    table = Table(key, every, 0, files)
    _publish(spark, folder, table)
    return table


def read_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows of some files with ``file_name`` and ``row_index`` beside the struct ``row``."""
    read = spark.read.parquet(*[f"{folder}/{name}" for name in names])
    return read.select(F.struct("*").alias("row"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def winners(changes: DataFrame, key: str, order: list[str], others: list[str]) -> DataFrame:
    """key (long) and the struct ``change`` of the change with the greatest ``order`` fields."""
    change = F.struct(*order, *[c for c in others if c not in order])
    return changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(change).alias("change"))


def _merged(spark: SparkSession, folder: str, table: Table, acting: DataFrame, homes: list[int], values: list[str]) -> DataFrame:
    """home, key, row, differs, stays: the rows of some files after the changes that act on them (key, home, change, gone)."""
    known = F.broadcast(spark.createDataFrame([(table.files[h].name, h) for h in homes], "file_name string, home int"))
    base = read_files(spark, folder, [table.files[h].name for h in homes]).join(known, "file_name")
    acting = acting.join(known, "home", "left_semi")
    columns = base.schema["row"].dataType.names
    rows = base.select("home", F.col("row")[table.key].cast("long").alias("key"), "row", F.lit(None).cast(acting.schema["change"].dataType).alias("change"), F.lit(None).cast("boolean").alias("gone"))
    changed = acting.select("home", "key", F.lit(None).cast(base.schema["row"].dataType).alias("row"), "change", "gone")
    dealt = rows.unionByName(changed).repartitionById(len(table.files), F.col("home"))
    of_key = Window.partitionBy("home", "key")
    met = dealt.withColumn("change", F.first("change", ignorenulls=True).over(of_key.orderBy(F.col("row").isNotNull()))).withColumn("gone", F.first("gone", ignorenulls=True).over(of_key.orderBy(F.col("row").isNotNull()))).withColumn("copies", F.count("row").over(of_key))
    is_base, is_changed = F.col("row").isNotNull(), F.col("change").isNotNull()
    kind = {f.name: f.dataType for f in base.schema["row"].dataType}
    new = lambda c: F.col("change")[c].cast(kind[c])
    after = F.struct(*[(new(c) if c in values else F.when(is_base, F.col("row")[c]).otherwise(F.col("key").cast(kind[c])) if c == table.key else F.col("row")[c]).alias(c) for c in columns])
    unequal = F.lit(False)
    for c in values:
        unequal = unequal | ~F.col("row")[c].eqNullSafe(new(c))
    kept = met.where(is_base | (~F.col("gone") & (F.col("copies") == 0)))
    return kept.select("home", "key", F.when(is_changed & ~F.coalesce("gone", F.lit(False)), after).otherwise(F.col("row")).alias("row"), (is_changed & (~is_base | F.col("gone") | unequal)).alias("differs"), (~F.coalesce("gone", F.lit(False))).alias("stays"))


def layout(files: list[tuple[bool, int]], every: int) -> list[tuple[int, int, int, bool]]:
    """The files that follow from (rewritten, rows) of each: (file, first row, rows, rewritten), where a file that
    was joined begins in the first of its parts and runs on.

    A rewritten file becomes as few as hold ``every`` rows each, sizes at most one apart, larger first; then each
    joins its left neighbour if that was rewritten too and both fit.
    """
    out: list[tuple[int, int, int, bool]] = []
    for home, (rewritten, rows) in enumerate(files):
        if not rewritten:
            out.append((home, 0, rows, False))
            continue
        pieces = -(-rows // every)
        start = 0
        for i in range(pieces):
            size = rows // pieces + (i < rows % pieces)
            if out and out[-1][3] and out[-1][2] + size <= every:
                out[-1] = (*out[-1][:2], out[-1][2] + size, True)
            else:
                out.append((home, start, size, True))
            start += size
    return out


def _spans(rows: dict[int, int], new: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, int]]:
    """(home, first row, last row + 1, file) for all that rewritten files of so many ``rows`` give to the new ones."""
    out, homes = [], iter(sorted((h, n) for h, n in rows.items() if n))
    home, left, low = -1, 0, 0
    for target, (_, _, size, _) in enumerate(new):
        while size:
            if not left:
                home, left = next(homes)
                low = 0
            taken = min(left, size)
            out.append((home, low, low + taken, target))
            low, left, size = low + taken, left - taken, size - taken
    return out


def apply_changes(spark: SparkSession, folder: str, changes: DataFrame, values: list[str], order: list[str], others: list[str], rule: Callable[[Column, Column], tuple[Column, Column]]) -> Table:
    """Apply the winning change of each key: set ``values``, insert, or delete.

    ``rule(change, first)`` gives two conditions, ignored and deletes, from the change's struct (``order``, ``others`` and
    ``values``) and the first key of the file that is its home.
    """
    importable(spark)
    table = read_manifest(spark, folder)
    if not table.files:
        return table
    firsts = [f.first for f in table.files]
    best = winners(changes, table.key, order, [*others, *values]).withColumn("home", range_of(F.col("key"), firsts))
    ignored, deletes = rule(F.col("change"), F.element_at(F.array(*[F.lit(x).cast("long") for x in firsts]), F.col("home") + 1))
    acting = write_shared(best.where(~F.coalesce(ignored, F.lit(False))).select("key", "home", "change", F.coalesce(deletes, F.lit(False)).alias("gone")), "changes")
    homes = sorted(r.home for r in acting.select("home").distinct().collect())  # at most one a file
    if not homes:
        return table
    merged = _merged(spark, folder, table, acting, homes, values)
    found = {r.home: r.rows for r in merged.groupBy("home").agg(F.max("differs").alias("differs"), F.sum(F.col("stays").cast("long")).alias("rows")).where("differs").select("home", "rows").collect()}
    plan = layout([(h in found, found.get(h, 0)) for h in range(len(table.files))], table.every)
    new = [p for p in plan if p[3]]
    names: dict[int, str] = {}
    if new:
        spans = F.broadcast(spark.createDataFrame(_spans(found, new), "home int, low int, high int, target int"))
        again = _merged(spark, folder, table, acting, sorted(found), values) if sorted(found) != homes else merged
        ranked = again.where("stays").withColumn("rank", F.row_number().over(Window.partitionBy("home").orderBy("key", F.xxhash64("row"))) - 1)
        aimed = ranked.join(spans, (ranked["home"] == spans["home"]) & (ranked["rank"] >= spans["low"]) & (ranked["rank"] < spans["high"]))
        written = aimed.select("row", "target", "key").repartitionById(len(new), F.col("target")).sortWithinPartitions("key").select("row.*")
        names = _write_parts(written, folder, f"c{table.commits + 1}")
    firsts_new = _first_keys(spark, folder, table.key, names)
    files = [File(names[i := new.index(p)], firsts_new[names[i]], True) if p[3] else table.files[p[0]] for p in plan]
    replaced = {table.files[h].name for h in found}
    after = Table(table.key, table.every, table.commits + 1, files)
    _publish(spark, folder, after)
    remover = Files(spark)
    for name in replaced:
        remover.delete(f"{folder}/{name}")
    return after


def _first_keys(spark: SparkSession, folder: str, key: str, names: dict[int, str]) -> dict[str, int]:
    if not names:
        return {}
    found = read_files(spark, folder, list(names.values())).groupBy("file_name").agg(F.min(F.col("row")[key].cast("long")).alias("first"))
    return {r.file_name: r.first for r in found.collect()}  # one row a new file


def _file_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole files in their order; one row a file, its keys hashed as they pass."""
    now, rows = None, []
    for batch in batches:
        numbers, keys, cents, crcs = (batch.column(i).to_pylist() for i in range(4))
        for number, key, cent, crc in zip(numbers, keys, cents, crcs):
            if now is None or now[0] != number:
                now = [number, key, 0, 0, 0, hashlib.sha256()]
                rows.append(now)
            now[5].update((b"," if now[2] else b"") + str(key).encode())
            now[2] += 1
            now[3] += cent
            now[4] += crc
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    done = [(*row[:5], row[5].hexdigest()) for row in rows]
    yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in done], k) for i, k in enumerate(kinds)], names=["file", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"])


def file_report(spark: SparkSession, folder: str, cents: Callable[[Column], Column], crc: Callable[[Column], Column]) -> DataFrame:
    """What lies in the folder, a row for each file, read from the files in their own order."""
    schema = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"
    table = read_manifest(spark, folder)
    if not table.files:
        return spark.createDataFrame([], schema)
    read = spark.read.parquet(*[f"{folder}/{f.name}" for f in table.files])
    known = spark.createDataFrame([(i, f.name, f"{folder}/{f.name}", f.rewritten) for i, f in enumerate(table.files)], "file int, file_name string, path string, rewritten boolean")
    rows = read_files(spark, folder, [f.name for f in table.files])
    thin = rows.select("file_name", "row_index", F.col("row")[table.key].cast("long").alias("key"), cents(F.col("row")).alias("cents"), crc(F.col("row")).alias("crc"))
    dealt = thin.join(F.broadcast(known.select("file_name", "file")), "file_name").repartitionById(len(table.files), F.col("file")).sortWithinPartitions("file", "row_index")
    digests = dealt.select("file", "key", "cents", "crc").mapInArrow(_file_digests, "file int, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    return digests.join(F.broadcast(known.drop("file_name")), "file").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(read.columns)).alias("columns"), "path", "rewritten")


def crc_of(text: Column) -> Column:
    return F.crc32(text.cast("string").cast("binary"))


def client_upsert(clients: DataFrame, changes: DataFrame, folder: str | None = None) -> DataFrame:
    """The contract of the query: clients by id, their changes, and a report of the files."""
    spark = clients.sparkSession
    folder = folder or kept_path(spark, "clients")
    every = 1 + clients.count() // 700
    write_table(clients.where(crc_of(F.col("client_id")) % 7 > 3), "client_id", every, folder)

    def rule(change: Column, first: Column) -> tuple[Column, Column]:
        h = crc_of(first) % 12
        return h > 7, (change["op"].eqNullSafe("D")) | (crc_of(change["change_id"]) % 8 < h)

    values = ["source", "segment", "city", "balance"]
    apply_changes(spark, folder, changes, values, ["seq", "change_id"], ["op"], rule)
    cents = lambda row: F.coalesce(F.floor(100 * row["balance"] + 0.5).cast("long"), F.lit(0))
    crc = lambda row: crc_of(F.concat_ws("|", *[F.coalesce(row[c], F.lit("")) for c in values[:3]]))
    return file_report(spark, folder, cents, crc)

