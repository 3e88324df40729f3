"""Tables laid out as sorted Parquet files of equal row counts, and the erasure of victims' rows from them.

``lay_out`` sorts a table by the crc32 of a key, then by all its columns, and writes consecutive rows to
numbered files. An exact histogram over prefixes of the crc32 gives each bucket's offset. Buckets over
their share are split at sampled rows of (crc32, all columns, a stored salt) and counted exactly, so
that neither a key with many rows nor equal rows stay together. A bucket or piece that lies inside one
file needs no ranks; the few that straddle a file's end get theirs by row_number. One shuffle by file
number follows, and each file is written whole by one task, streaming.

``erase`` flags the rows of each file whose key is a victim by joins that AQE splits where a key is
hot, and rewrites only the files that hold some: a task streams the old file past the flagged positions
into a new one, whose footer knows the survivors alone. Nothing is changed in place: a task that is
lost or repeated writes the same file again, and old files go once all new ones are there.

Nulls sort first, a null key as the empty string; equal rows may take any order among themselves; an
empty table has no files. Columns may have any names. Columns must be orderable (no maps).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.storage import fresh_path, written

#: Buckets of the histogram are 2 ** PREFIX_BITS prefixes; one with over 1 / PIECES of the rows is split, at every SAMPLE-th sampled row.
PREFIX_BITS, PIECES, SAMPLE = 12, 2048, 32
#: Rows of a row group.
GROUP_ROWS = 65_536
#: Least number of tasks that files are dealt to, if there are as many files.
TASKS = 24


@dataclass(frozen=True)
class Table:
    """What is laid out: the columns of rows, the key whose crc32 leads the order, the column that victims are known by, and their values."""

    name: str
    rows: DataFrame
    columns: list[str]
    key: Column
    victim_column: str
    victims: DataFrame


def crc(key: Column) -> Column:
    """crc32 of the key as text; a null one counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _free(name: str, columns: list[str]) -> str:
    """A column name that no other column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(file number, rows of that file) of batches whose first column is the file number, in order."""
    for b in batches:
        numbers = b.column(0).to_numpy(zero_copy_only=False)
        ends = [*np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
        for lo, hi in zip([0, *ends], ends, strict=False):
            if hi > lo:
                yield int(numbers[lo]), b.slice(lo, hi - lo)


class _Writer:
    """A Parquet file that appears under its name when it is complete, and not at all if it has no rows."""

    def __init__(self, path: str, schema: pa.Schema) -> None:
        self.fs, self.path = _opened(path)
        folder, _, name = self.path.rpartition("/")
        self.part, self.schema, self.rows, self.held, self.to = f"{folder}/_{name}-{uuid.uuid4().hex}", schema, 0, [], None

    def add(self, rows: pa.Table) -> None:
        if rows.num_rows:
            self.held.append(rows)
            self.rows += rows.num_rows
            if sum(t.num_rows for t in self.held) >= GROUP_ROWS:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            self.to = self.to or pq.ParquetWriter(self.part, self.schema, filesystem=self.fs)
            self.to.write_table(pa.concat_tables(self.held))
            self.held = []

    def close(self) -> int:
        self._flush()
        if self.to:
            self.to.close()
            self.fs.move(self.part, self.path)
        return self.rows


def _dealt(spark: SparkSession, df: DataFrame, number: str, files: int) -> DataFrame:
    """df dealt by file number, some files to a task, as the cluster has cores."""
    tasks = min(files, max(TASKS, 4 * spark.sparkContext.defaultParallelism))
    return df.repartitionById(tasks, F.floor(F.col(number) * tasks / files).cast("int"))


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, parts in groupby(_segments(batches), key=itemgetter(0)):
        to = None
        for _, b in parts:
            rows = pa.table(b.columns[1:], schema=pa.schema(list(b.schema)[1:]))
            to = to or _Writer(f"{folder}/{number:05d}.parquet", rows.schema)
            to.add(rows)
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "n_rows": pa.array([to.close()], pa.int64())})


def _rewrite(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches (file number, position) in order: each file without those positions under a new name."""
    for number, parts in groupby(_segments(batches), key=itemgetter(0)):
        where, path = _opened(f"{folder}/{number:05d}.parquet")
        flagged = (p.column(1).to_numpy() for _, p in parts)
        at, start, erased = np.empty(0, np.int64), 0, 0
        with where.open_input_file(path) as source:
            old = pq.ParquetFile(source)
            to = _Writer(f"{folder}/{number:05d}-erased.parquet", old.schema_arrow)
            for batch in old.iter_batches(GROUP_ROWS):
                while not len(at) or at[-1] < start + len(batch):
                    more = next(flagged, None)
                    if more is None:
                        break
                    at = np.concatenate([at, more])
                here = np.searchsorted(at, start + len(batch))
                keep = np.ones(len(batch), bool)
                keep[at[:here] - start] = False
                to.add(pa.Table.from_batches([batch]).filter(pa.array(keep)))
                at, start, erased = at[here:], start + len(batch), erased + int(here)
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "n_rows": pa.array([to.close()], pa.int64()), "n_erased": pa.array([erased], pa.int64())})


def _cuts(keyed: DataFrame, bucket: Column, order: Column, shares: dict[int, int]) -> DataFrame:
    """(bucket, cuts): rows at which a large bucket is split; their number is bounded by PIECES, whatever the rows."""
    spark = keyed.sparkSession
    rate = spark.createDataFrame([(b, float(s)) for b, s in shares.items()], "b int, rate double")
    sample = keyed.withColumn("b", bucket).join(F.broadcast(rate), "b").filter(F.rand() < F.col("rate")).select("b", order.alias("o"))
    ranked = sample.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("o"))).filter(F.col("r") % SAMPLE == 0)
    return ranked.groupBy("b").agg(F.array_sort(F.collect_list("o")).alias("cuts"))


def _below(cuts: Column, key: Column, most: int) -> Column:
    """How many of the sorted cuts are at or below the key, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.try_element_at(cuts, n + s) <= key, n + s).otherwise(n)), F.lit(0))


def file_numbers(rows: DataFrame, columns: list[str], key: Column, size_of: Callable[[int], int]) -> tuple[DataFrame, int, str, str]:
    """(columns of rows with a file number and a crc32 besides, number of files, the names of these two columns).

    size_of gives a file's rows from the table's. Only counts of buckets and pieces come to the driver,
    at most 2 ** PREFIX_BITS and a few times PIECES.
    """
    c, salt, b, cuts_of, piece, number, offset, first, last = (_free(n, columns) for n in ("crc", "salt", "bucket", "cuts", "piece", "file_no", "offset", "first_file", "last_file"))
    own = [F.col(f"`{x}`") for x in columns]
    keyed = written(rows.select(*own, crc(key).alias(c), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).cast("int").alias(salt)), "keyed")
    spark, bucket = rows.sparkSession, F.shiftright(c, 32 - PREFIX_BITS).cast("int")
    counts = {r[0]: r[1] for r in keyed.groupBy(bucket).count().collect()}
    total = sum(counts.values())
    size, share = size_of(total), max(1, total // PIECES)
    order = F.struct(c, *own, salt)
    placed, pieces = keyed.withColumns({b: bucket, piece: F.lit(0)}), {(k, 0): n for k, n in counts.items()}
    if large := {k: n for k, n in counts.items() if n > share and k is not None}:
        cuts = written(_cuts(keyed, bucket, order, {k: min(1.0, SAMPLE * -(-n // share) / n) for k, n in large.items()}), "cuts")
        # binary search over at most twice the rows sampled for PIECES
        placed = keyed.withColumn(b, bucket).join(F.broadcast(cuts.withColumnsRenamed({"b": b, "cuts": cuts_of})), b, "left").withColumn(piece, _below(F.col(cuts_of), order, 4 * PIECES))
        split = placed.filter(F.col(b).isin(*large)) if len(large) <= 50 else placed.join(F.broadcast(spark.createDataFrame([(k,) for k in large], f"{b} int")), b)
        pieces = {k: n for k, n in pieces.items() if k[0] not in large} | {(r[0], r[1]): r[2] for r in split.groupBy(b, piece).count().collect()}
    spans, start = [], 0
    for (k, p), n in sorted(pieces.items()):
        spans.append((k, p, start, start // size, (start + n - 1) // size))
        start += n
    known = F.broadcast(spark.createDataFrame(spans, f"`{b}` int, `{piece}` int, `{offset}` long, `{first}` long, `{last}` long"))
    found = placed.join(known, [b, piece])
    inside = found.filter(F.col(first) == F.col(last)).withColumn(number, F.col(first))
    rank = F.row_number().over(Window.partitionBy(b, piece).orderBy(c, *own, salt))
    across = found.filter(F.col(first) < F.col(last)).withColumn(number, F.floor((F.col(offset) + rank - 1) / size))
    return inside.select(number, c, *own).unionByName(across.select(number, c, *own)), -(-total // size), number, c


def lay_out(rows: DataFrame, columns: list[str], key: Column, folder: str, size_of: Callable[[int], int]) -> list[tuple[int, int]]:
    """Write columns of rows as files 00000.parquet and so on in folder; (file number, rows) of each."""
    own = [F.col(f"`{x}`") for x in columns]
    numbered, files, number, c = file_numbers(rows, columns, key, size_of)
    where, path = _opened(folder)
    where.create_dir(path, recursive=True)
    if not files:
        return []
    dealt = _dealt(rows.sparkSession, numbered, number, files).sortWithinPartitions(number, c, *own)
    done = dealt.select(number, *own).mapInArrow(partial(_write, folder), "file_no long, n_rows long")
    return sorted(tuple(r) for r in done.collect())


def flagged(spark: SparkSession, folder: str, victim_column: str, victims: DataFrame) -> DataFrame:
    """(file_no, position) of the rows in folder's files whose victim_column is among the values of victims."""
    files = spark.read.parquet(folder).select(F.col(f"`{victim_column}`").alias("v"), F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("file_no"), F.col("_metadata.row_index").alias("position"))
    return files.join(victims.toDF("v"), "v", "left_semi").select("file_no", "position")


def erase(spark: SparkSession, folder: str, files: list[tuple[int, int]], victim_column: str, victims: DataFrame) -> list[tuple[int, int, int, bool, str]]:
    """Rewrite the files that hold victims; (file number, rows, erased rows, rewritten, path) of each file that is left."""
    if not files:
        return []
    found = flagged(spark, folder, victim_column, victims)
    dealt = _dealt(spark, found, "file_no", len(files)).sortWithinPartitions("file_no", "position")
    changed = {r.file_no: r for r in dealt.mapInArrow(partial(_rewrite, folder), "file_no long, n_rows long, n_erased long").collect()}
    left = [(n, changed[n].n_rows, changed[n].n_erased, True, f"{folder}/{n:05d}-erased.parquet") if n in changed else (n, rows, 0, False, f"{folder}/{n:05d}.parquet") for n, rows in files]
    left = [x for x in left if x[1]]
    where, path = _opened(folder)
    stays = {x[4].rpartition("/")[2] for x in left}
    for f in where.get_file_info(pafs.FileSelector(path)):  # old forms of rewritten files and what lost tasks left
        if f.base_name not in stays:
            where.delete_file(f.path)
    return left


def erased_tables(spark: SparkSession, tables: list[Table], size_of: Callable[[int], int], root: str | None = None) -> DataFrame:
    """Lay out each table in a folder of its own below a new one and erase its victims.

    Returns (table_name, file_no, n_rows, n_erased, rewritten, columns, path), one row for each file that is left.
    """
    root, out = root or fresh_path(spark, "erasure"), []
    for t in tables:
        folder = f"{root}/{t.name}"
        files = lay_out(t.rows, t.columns, t.key, folder, size_of)
        out += [(t.name, *x[:4], ",".join(t.columns), x[4].removeprefix("file://")) for x in erase(spark, folder, files, t.victim_column, t.victims)]
    return spark.createDataFrame(out, "table_name string, file_no long, n_rows long, n_erased long, rewritten boolean, columns string, path string")


def _digest(amounts: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cents, shas = [], []
        for name, path in zip(b.column("table_name").to_pylist(), b.column("path").to_pylist(), strict=True):
            where, p = _opened(path)
            with where.open_input_file(p) as source:
                file = pq.ParquetFile(source)
                sha, total, sep = hashlib.sha256(), 0, ""
                ids, x = file.schema_arrow.names[0], amounts[name]
                for rows in file.iter_batches(GROUP_ROWS, columns=[ids, x]):
                    sha.update((sep + ",".join("" if i is None else str(i) for i in rows.column(ids).to_pylist())).encode())
                    value = 100 * rows.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.5
                    total, sep = total + int(np.floor(value[np.isfinite(value)]).astype(np.int64).sum()), ","
            cents.append(total)
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cents, pa.int64()), pa.array(shas)], names=[*b.schema.names, "cents", "ids_sha256"])


def digests(files: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """files (as of erased_tables) with cents, the sum of floor(100 * x + 0.5) of the table's amount column
    (nulls and what is not finite count 0), and ids_sha256, of the first column's values joined by commas: both read from the files."""
    return files.repartition(max(TASKS, 4 * files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(partial(_digest, amounts), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", cents long, ids_sha256 string")


def victim_masters(clients: DataFrame, clicks: DataFrame, divisor: int = 100) -> DataFrame:
    """(master_id): those whose crc32 the divisor divides, and the one whose clients have most clicks (ties: the smallest)."""
    clicked = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    owned = clients.filter("master_id is not null").select("master_id", "client_id").distinct()
    by = written(owned.join(clicked, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")), "masters")
    most = by.orderBy(F.desc("n"), "master_id").limit(1)
    return by.filter(crc(F.col("master_id")) % divisor == 0).unionByName(most).select("master_id").distinct()


def cascade(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame) -> list[Table]:
    """The four tables with their victims: clients of victim masters, their clicks and sales, and these sales' lines.

    A sale that repeats has the smallest of its clients; a line without a sale has none.
    """
    masters = written(victim_masters(clients, clicks), "victim-masters")
    gone = written(clients.join(masters, "master_id", "left_semi").filter("client_id is not null").select("client_id").distinct(), "victim-clients")
    gone_sales = written(sales.join(gone, "client_id", "left_semi").filter("sale_id is not null").select("sale_id").distinct(), "victim-sales")
    owner = _free("owner", sale_lines.columns)
    # written, so that both sides of the join are plain shuffles, which AQE splits where a sale is hot
    owners = written(sales.filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias(owner)), "owners")
    return [
        Table("clients", clients, clients.columns, F.col("client_id"), "master_id", masters),
        Table("clicks", clicks, clicks.columns, F.col("client_id"), "client_id", gone),
        Table("sales", sales, sales.columns, F.col("client_id"), "client_id", gone),
        Table("sale_lines", sale_lines.join(owners, "sale_id", "left"), sale_lines.columns, F.col(owner), "sale_id", gone_sales),
    ]
