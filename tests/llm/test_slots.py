"""Virtual slots: the law of the shards, the map's versions and the numbering."""

import heapq
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from journalsieve.llm import queries, slots


def _docs():
    rows = [(i, "wort " * (i * i % 97)) for i in range(400)]
    rows += [(None, None)] * 30 + [(None, "ohne Nummer")] * 2 + [(5, "anderer Text"), (7, ""), (7, "")]
    return rows + [(1000 + i, "kopie äöü 😀") for i in range(200)]


def test_query(spark, tmp_path):
    rows = _docs()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as size", "2 as shard", "'z' as id", "3 as n").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_virtual_slots(spark, str(tmp_path)).collect()
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted((facts(*r) for r in rows), key=repr)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    bytes_of, places, slot_bytes, home = defaultdict(int), defaultdict(list), defaultdict(int), {}
    for r in got:
        bytes_of[r.shard] += r.size
        places[r.shard].append(r.slot)
        slot_bytes[r.virtual_slot] += r.size
        assert home.setdefault(r.virtual_slot, r.shard) == r.shard  # a slot lies in one shard
        assert r.next_version_shard in (r.shard, 8)  # one more shard takes slots only into itself
    assert set(bytes_of) == set(range(8))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= min(slot_bytes.values()) + max(slot_bytes.values()) / 8
    grown = defaultdict(int)
    for r in got:
        grown[r.next_version_shard] += r.size
    assert 0.8 < grown[8] * 9 / sum(grown.values()) < 1.3
    # brute force: largest slot first, to the shard with the fewest bytes
    loads, dealt = [(0, s) for s in range(8)], {}
    for size, slot in sorted(((-b, s) for s, b in slot_bytes.items())):
        filled, shard = heapq.heappop(loads)
        heapq.heappush(loads, (filled - size, shard))
        dealt[slot] = shard
    assert home == dealt


def test_map_versions(spark, tmp_path):
    folder = f"{tmp_path}/map"
    rows = slots.with_slots(spark.createDataFrame(_docs(), "doc_id long, text string"), slots=64)
    loads = slots.slot_loads(rows, slots=64).cache()
    assert slots.newest_version(spark, folder) is None
    assert [slots.edit_map(folder, loads, n) for n in (4, 4, 5, 3)] == [0, 1, 2, 3]
    maps = [{r.slot: r.shard for r in slots.read_map(spark, folder, v).collect()} for v in range(4)]
    assert all(set(m) == set(range(64)) for m in maps) and slots.newest_version(spark, folder) == 3
    assert set(maps[3].values()) == {0, 1, 2}
    assert all(a == b or b == 4 for a, b in ((maps[1][s], maps[2][s]) for s in range(64)))
    size = {r.slot: r.bytes for r in loads.collect()}
    for m, shards in zip(maps, (4, 4, 5, 3)):
        filled = [sum(size[s] for s in m if m[s] == k) for k in range(shards)]
        assert max(filled) - min(filled) <= 2 * max(size.values())
    # an edit after growth of one slot moves little
    more = loads.withColumn("bytes", F.when(F.col("slot") == 3, F.col("bytes") + 5000).otherwise(F.col("bytes")))
    slots.edit_map(folder, more, 3)
    last = {r.slot: r.shard for r in slots.read_map(spark, folder, 4).collect()}
    assert sum(last[s] != maps[3][s] for s in last) < 32
    with pytest.raises(Exception, match="exist"):
        slots.store_map(slots.read_map(spark, folder, 0), folder, 0)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_virtual_slots(spark, str(tmp_path))
    assert got.collect() == [] and {"shard", "slot", "grown_shard", "law"} <= set(got.columns)
