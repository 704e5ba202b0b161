"""The log of last accesses over batches with late rows, repeated batches and expiry."""

import random

import pytest

from tessera.streaming import latest


def test_cover_is_whole_and_follows_the_folds():
    for batches in range(70):
        blocks = latest.cover(batches)
        covered = [n for level, start in blocks for n in range(start, start + 4**level)]
        assert covered == list(range(batches))
        levels = [level for level, _ in blocks]
        assert levels == sorted(levels, reverse=True) and all(start % 4**level == 0 for level, start in blocks)


@pytest.mark.parametrize("retention", [10**9, 300])
def test_log_is_the_latest_of_all_rows(spark, retention):
    rnd = random.Random(retention)
    log, rows = latest.LatestLog(spark, retention), []
    for number in range(9):
        batch = [
            (f"c{rnd.randrange(12)}", f"w{rnd.randrange(4)}", rnd.randint(max(0, 100 * number - 250), 100 * number + 100), 1_000 * number + k, rnd.choice([True, False, None]))
            for k in range(30)
        ]
        batch += batch[:3]  # repeated rows
        frame = spark.createDataFrame(batch, latest.SCHEMA).coalesce(2)
        log.put(frame, number)
        if number in (3, 5):
            log.put(frame, number)  # done again after a restart
        rows += batch
        if number in (0, 3, 4, 8):
            newest = max(r[2] for r in rows)
            want = {}
            for r in sorted(rows, key=lambda r: (r[2], r[3])):
                want[r[:2]] = r
            assert sorted(map(tuple, log.read(number + 1).collect())) == sorted(r for r in want.values() if r[2] >= newest - retention)
    written = spark.read.schema(latest.SCHEMA).parquet(log.folder(0, 8))
    assert written.count() <= 30  # the last batch's own keys
    folded = spark.read.schema(latest.SCHEMA).parquet(log.folder(1, 4))
    newest = max(r[2] for r in rows[33 * 4 : 33 * 8])
    assert folded.filter(f"at_ms < {newest - retention}").count() == 0


def test_nothing_came(spark):
    assert latest.LatestLog(spark, 5).read(0).count() == 0
