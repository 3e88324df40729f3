"""Erasure from sorted files against plain Python: order, file borders, victims, footers and folders."""

import datetime
import hashlib
import math
import os
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark.llm import erasure, queries
from tests.conftest import DATA

AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def text_crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def ordered(rows, columns, key):
    place = lambda v: (v is not None, v.encode() if isinstance(v, str) else 0 if v is None else v)
    return sorted(rows, key=lambda r: (text_crc(key(r)), [place(r[c]) for c in columns]))


def brute(tables):
    """(table, file_no) -> (rows, erased, cents, rewritten, ids_sha256, rows left)."""
    clients, clicks, sales, lines = (tables[t] for t in ("clients", "clicks", "sales", "sale_lines"))
    per = Counter(r["client_id"] for r in clicks if r["client_id"] is not None)
    masters = {r["master_id"] for r in clients} - {None}
    own = {m: {r["client_id"] for r in clients if r["master_id"] == m} for m in masters}
    gone_masters = {m for m in masters if text_crc(m) % 100 == 0} | ({min(masters, key=lambda m: (-sum(per[c] for c in own[m]), m))} if masters else set())
    gone = {c for m in gone_masters for c in own[m]} - {None}
    gone_sales = {r["sale_id"] for r in sales if r["client_id"] in gone} - {None}
    owner = {r["sale_id"]: r["client_id"] for r in sales}
    key = {"sale_lines": lambda r: owner.get(r["sale_id"])}
    victim = {"clients": lambda r: r["master_id"] in gone_masters, "sale_lines": lambda r: r["sale_id"] in gone_sales}
    out = {}
    for name, rows in tables.items():
        rows = ordered(rows, list(rows[0]) if rows else [], key.get(name, lambda r: r["client_id"]))
        size = 1 + len(rows) // 150
        for no in range(-(-len(rows) // size)):
            part = rows[no * size : (no + 1) * size]
            left = [r for r in part if not victim.get(name, lambda r: r["client_id"] in gone)(r)]
            if left:
                cents = sum(math.floor(100 * r[AMOUNT[name]] + 0.5) for r in left if r[AMOUNT[name]] is not None)
                ids = ",".join("" if (v := next(iter(r.values()))) is None else str(v) for r in left)
                out[name, no] = (len(left), len(part) - len(left), cents, len(left) < len(part), hashlib.sha256(ids.encode()).hexdigest(), left)
    return out


def agrees(found, tables):
    want = brute(tables)
    got = {(r.table_name, r.file_no): r for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    folders = {}
    for k, r in got.items():
        assert (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) == want[k][:5], k
        file = pq.ParquetFile(r.path)
        assert ",".join(file.schema_arrow.names) == r.columns
        assert file.read().to_pylist() == want[k][5], k
        n = file.metadata.num_row_groups
        for i, name in enumerate(file.schema_arrow.names):
            values = [v for x in want[k][5] if (v := x[name]) is not None]
            stats = [file.metadata.row_group(g).column(i).statistics for g in range(n)]
            assert sum(s.null_count for s in stats) == r.n_rows - len(values), (k, name)
            if values and all(s.has_min_max for s in stats) and isinstance(values[0], int):
                assert (min(s.min for s in stats), max(s.max for s in stats)) == (min(values), max(values))
        folders.setdefault(os.path.dirname(r.path), set()).add(os.path.basename(r.path))
    for folder, names in folders.items():
        assert set(os.listdir(folder)) == names


@pytest.fixture(scope="module")
def shop():
    return {t: pq.read_table(f"{DATA}/sf0.001/{t}.parquet").to_pylist() for t in AMOUNT}


def test_query(spark, shop):
    agrees(queries.op12_erasure(spark, f"{DATA}/sf0.001").collect(), shop)


def test_hot_key_equal_rows_and_nulls(spark, monkeypatch):
    """One client with most rows, thousands of equal rows, null keys, lines without a sale: the split of buckets is exact."""
    monkeypatch.setattr(erasure, "PREFIX_BITS", 3)
    monkeypatch.setattr(erasure, "PIECES", 64)
    ts = datetime.datetime(2024, 1, 1)
    clients = [{"client_id": i, "master_id": None if i % 5 == 0 else i % 40, "updated_at": ts, "name": f"é{i}" if i % 3 else None, "balance": i / 7 if i % 4 else None} for i in range(200)]
    clients += [{"client_id": None, "master_id": 7, "updated_at": None, "name": "", "balance": -1.005}] * 2
    clicks = [{"click_id": i, "client_id": 7 if i % 3 else (None if i % 2 else i % 211), "value": 0.005 * i, "file_no": 1} for i in range(3000)]
    clicks += [{"click_id": 5, "client_id": 9, "value": 1.0, "file_no": None}] * 2500
    sales = [{"sale_id": i, "client_id": (7 if i % 2 else i % 190) if i % 11 else None, "total": 1.0 * i} for i in range(800)]
    lines = [{"sale_id": 14 if i % 3 else (None if i % 5 == 0 else i), "line_no": i % 4, "amount": 2.5, "crc": "x"} for i in range(2400)]
    tables = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}
    frames = [spark.createDataFrame([tuple(x.values()) for x in r], s) for r, s in zip(tables.values(), SCHEMAS, strict=True)]
    files = erasure.erased_tables(spark, erasure.cascade(*frames), size_of=lambda n: 1 + n // 150)
    agrees(erasure.digests(files, AMOUNT).collect(), tables)


SCHEMAS = (
    "client_id long, master_id long, updated_at timestamp_ntz, name string, balance double",
    "click_id long, client_id long, value double, file_no long",
    "sale_id long, client_id long, total double",
    "sale_id long, line_no long, amount double, crc string",
)


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], s) for s in SCHEMAS]
    assert erasure.erased_tables(spark, erasure.cascade(*frames), size_of=lambda n: 1 + n // 150).count() == 0


def test_no_clicks_picks_the_smallest_master(spark):
    clients = spark.createDataFrame([(i, 10 - i) for i in range(5)], "client_id long, master_id long")
    clicks = spark.createDataFrame([], "client_id long")
    assert {r.master_id for r in erasure.victim_masters(clients, clicks, divisor=1 << 40).collect()} == {6}


def test_a_repeated_task_writes_the_same_file(spark, tmp_path):
    """Writing and rewriting a file again, as after a lost executor, changes nothing; parts of dead tasks go."""
    rows = spark.range(500).withColumn("k", F.col("id") % 3)
    folder = f"{tmp_path}/t"
    files = erasure.lay_out(rows, ["id", "k"], F.col("k"), folder, lambda n: 100)
    flagged = pa.RecordBatch.from_pydict({"file_no": pa.array([0, 0, 1], pa.int64()), "position": pa.array([0, 5, 99], pa.int64())})
    again = [[b.to_pylist() for b in erasure._rewrite(folder, iter([flagged]))] for _ in range(2)]
    assert again[0] == again[1] == [[{"file_no": 0, "n_rows": 98, "n_erased": 2}], [{"file_no": 1, "n_rows": 99, "n_erased": 1}]]
    open(f"{folder}/_00002.parquet-dead", "wb").close()
    victims = spark.createDataFrame([(0,)], "k long")
    left = erasure.erase(spark, folder, files, "k", victims)
    assert sum(x[1] for x in left) == 333 and sum(x[2] for x in left) <= 167
    assert set(os.listdir(folder)) == {os.path.basename(x[4]) for x in left}
