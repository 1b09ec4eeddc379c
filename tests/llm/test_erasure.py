import hashlib
import random
import zlib
from datetime import datetime
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomwork.llm import erasure
from loomwork.llm.queries import op13_erasure
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
SF = "/root/testdata/sf0.001"


def brute(tables):
    """Rows of each table as the contract sorts, cuts and erases them, in plain Python."""
    crc = lambda v: zlib.crc32(("" if v is None else str(v)).encode())
    nulls = lambda row: tuple((v is not None, v) if v is not None else (False, 0) for v in row)
    col = {t: {c: i for i, c in enumerate(names)} for t, (names, _) in tables.items()}
    owner = {}
    for r in tables["sales"][1]:
        owner.setdefault(r[0], r[col["sales"]["client_id"]])
    of = {t: (lambda r, i=col[t]["client_id"]: r[i]) for t in ("clients", "clicks", "sales")}
    of["sale_lines"] = lambda r: owner.get(r[0])
    clicks = {}
    for r in tables["clicks"][1]:
        if (c := of["clicks"](r)) is not None:
            clicks[c] = clicks.get(c, 0) + 1
    masters = {}
    for r in tables["clients"][1]:
        if (m := r[col["clients"]["master_id"]]) is not None:
            masters.setdefault(m, set()).add(r[0])
    most = min(masters, key=lambda m: (-sum(clicks.get(c, 0) for c in masters[m]), m), default=None)
    gone = {m for m in masters if crc(m) % 100 == 0} | {most} - {None}
    clients = {c for m in gone for c in masters[m]} - {None}
    sales = {r[0] for r in tables["sales"][1] if r[col["sales"]["client_id"]] in clients} - {None}
    dead = {
        "clients": lambda r: r[col["clients"]["master_id"]] in gone,
        "clicks": lambda r: of["clicks"](r) in clients,
        "sales": lambda r: of["sales"](r) in clients,
        "sale_lines": lambda r: r[0] in sales,
    }
    out = {}
    for t, (_, rows) in tables.items():
        rows = sorted(rows, key=lambda r: (crc(of[t](r)), nulls(r)))
        size = 1 + len(rows) // 150
        for k in range(0, len(rows), size):
            file = rows[k : k + size]
            left = [r for r in file if not dead[t](r)]
            if left:
                amount = col[t][AMOUNTS[t]]
                cents = sum(0 if r[amount] is None else int((100 * r[amount] + 0.5) // 1) for r in left)
                sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                out[t, k // size] = (len(left), len(file) - len(left), cents, len(left) < len(file), sha, left)
    return out


def check(spark, folder, tables):
    got = op13_erasure(spark, str(folder)).collect()
    want = brute(tables)
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256) for r in got} == {k: v[:5] for k, v in want.items()}
    for r in got:
        names = tables[r.table_name][0]
        assert r["columns"] == ",".join(names)
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        assert file.schema_arrow.names == names
        rows = want[r.table_name, r.file_no][5]
        assert list(zip(*file.read().to_pydict().values())) == rows  # whole rows, in order
        meta = file.metadata.row_group(0).column(0).statistics
        ids = [x[0] for x in rows if x[0] is not None]
        assert file.metadata.num_rows == len(rows)
        if ids and file.metadata.num_row_groups == 1:
            assert (meta.min, meta.max) == (min(ids), max(ids))
    if got:
        root = Path(got[0].path.removeprefix("file:")).parents[2]
        assert {str(p) for p in root.rglob("*.parquet")} == {r.path.removeprefix("file:") for r in got}
    return got


def test_query_matches_brute_force(spark):
    tables = {}
    for t in AMOUNTS:
        found = duckdb.execute(f"SELECT * FROM '{SF}/{t}.parquet'")
        tables[t] = [d[0] for d in found.description], found.fetchall()
    assert any(r.n_erased for r in check(spark, SF, tables))


def put(folder, tables, schemas):
    for t, (names, rows) in tables.items():
        pq.write_table(pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schemas[t]), folder / f"{t}.parquet")


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_nulls_repeats_ties_empty_tables_and_clashing_columns(spark, tmp_path, rows):
    rng = random.Random(rows)
    pick = lambda n: rng.choice([None, *range(n)])
    at = lambda: rng.choice([None, datetime(2024, 1, rng.randint(1, 28))])
    money = lambda: rng.choice([None, 0.0, round(rng.uniform(-9, 99), 2)])
    names = {
        "clients": ["client_id", "master_id", "file_no", "updated_at", "balance"],
        "clicks": ["click_id", "ts", "client_id", "value", "_metadata"],
        "sales": ["sale_id", "client_id", "total", "lw_file_no", "file_no"],
        "sale_lines": ["sale_id", "line_no", "amount", "path", "a.b"],
    }
    made = {
        "clients": [(i, pick(9), pick(3), at(), money()) for i in range(rows // 7)],
        "clicks": [(pick(40), at(), 3 if rng.random() < 0.4 else pick(rows // 5 + 2), money(), "x") for _ in range(rows)],
        "sales": [(i, 3 if rng.random() < 0.3 else pick(rows // 5 + 2), money(), pick(2), "y") for i in range(rows // 2)],
        "sale_lines": [(pick(rows // 2 + 9), pick(3), money(), rng.choice([None, "", "é"]), 1) for _ in range(rows)],
    }
    long, text, time, num = pa.int64(), pa.string(), pa.timestamp("us"), pa.float64()
    kinds = {"clients": [long, long, long, time, num], "clicks": [long, time, long, num, text], "sales": [long, long, num, long, text], "sale_lines": [long, long, num, text, long]}
    tables = {t: (names[t], made[t] + made[t][:5] * (t in ("clicks", "sale_lines"))) for t in names}
    put(tmp_path, tables, {t: pa.schema(list(zip(names[t], kinds[t]))) for t in names})
    got = check(spark, tmp_path, tables)
    assert bool(got) == (rows > 0)


def test_intervals_are_islands_split_at_files(spark):
    rows = spark.createDataFrame([(0, 3), (0, 4), (0, 4), (1, 0), (1, 1), (3, 2), (None, 1)], f"{erasure.FILE} long, {erasure.PLACE} long")
    assert sorted(map(tuple, erasure.intervals(rows, 5).collect())) == [(0, 3, 4), (1, 0, 1), (3, 2, 2)]
    most = spark.range(70_000).select(F.lit(0).cast("long").alias(erasure.FILE), F.col("id").alias(erasure.PLACE))
    assert sorted(map(tuple, erasure.intervals(most, 100_000).collect())) == [(0, 0, 65535), (0, 65536, 69999)]


def test_survivors_over_batches_of_any_size():
    rng = random.Random(5)
    for size in (1, 2, 7, 100):
        rows, want = [], []
        for file in range(4):
            place = 0
            while place < 40:
                last = min(39, place + rng.randint(0, 9))
                if rng.random() < 0.4:
                    rows.append((file, place, last, None))
                    rows += [(file, p, None, "gone") for p in range(place, last + 1)]
                else:
                    rows += [(file, p, None, f"{file}-{p}") for p in range(place, last + 1)]
                    want += [f"{file}-{p}" for p in range(place, last + 1)]
                place = last + 1
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["f", "p", "l", "v"])
        parts = [batch.slice(k, size) for k in range(0, len(rows), size)]
        assert [v for b in erasure.survivors(iter(parts)) for v in b.column(2).to_pylist()] == want


def test_files_without_victims_stay_and_a_rerun_changes_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    rows = spark.range(600).select("id", F.concat(F.lit("v"), "id").alias("v"))
    folder = str(tmp_path / "t")
    size = erasure.write_sorted(rows, F.col("id") * 0, schema, folder)
    assert size == 5
    before = {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")}
    victims = lambda: erasure.victims_of(erasure.stored(spark, folder, schema), "id", spark.createDataFrame([(7,), (8,), (10,), (11,), (12,), (13,), (14,), (9999,), (None,)], "k long"))
    erasure.rewrite(spark, folder, schema, erasure.intervals(victims(), size))
    after = {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")}
    assert {str(p.parent.name) for p in set(before) - set(after)} == {"file_no=1", "file_no=2"} and {p.parent.name for p in set(after) - set(before)} == {"file_no=1"}
    assert all(before[p] == after[p] for p in set(before) & set(after))
    assert erasure.rewrite(spark, folder, schema, erasure.intervals(victims(), size)).count() == 0
    assert {p: p.read_bytes() for p in Path(folder).rglob("*.parquet")} == after
