import zlib

from quarry.llm import sharding as S


def test_assign_equals_one_pass(spark, tmp_path):
    rows = [(i, "é" * (i * 37 % 101)) for i in range(200)] + [(5, "same")] * 300
    rows += [(None, None), (None, "x"), (9, ""), (11, "y" * 3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, size int")
    raw = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for i, t in rows))
    total, at, want, slots = sum(r[2] for r in raw), 0, [], {}
    for known, i, size, crc in raw:
        shard = at * 8 // total
        want.append((i if known else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in S.assign(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert S.assign(df.limit(0)).count() == 0
    S.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
