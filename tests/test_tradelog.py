"""Commits of the trade log: writers at once, repeated batches, readers of a version."""

import threading

from tapeloom.sources import sinks, tradelog

SCHEMA = "symbol string, life long, net double"


def rows(spark, lives):
    return spark.createDataFrame([("A", i, float(i)) for i in lives], SCHEMA)


def lives(spark, path, version=None):
    return sorted(r["life"] for r in tradelog.snapshot(spark, path, SCHEMA, version).collect())


def test_two_writers_at_once_never_double_a_lifecycle(spark):
    path = sinks.scratch(spark, "log")
    meet, tries = threading.Barrier(2), {0: 0, 1: 0}

    def write(who, of):
        def wait():  # both have read the same version and written their data before either commits
            tries[who] += 1
            if tries[who] == 1:
                meet.wait(60)

        tradelog.append(rows(spark, of), path, before_commit=wait)

    threads = [threading.Thread(target=write, args=(i, of)) for i, of in enumerate((range(0, 20), range(10, 30)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert lives(spark, path) == list(range(30))
    assert tradelog.versions(spark, path) == [1, 2] and sorted(tries.values()) == [1, 2]  # one of them had to try again


def test_readers_see_all_or_nothing(spark):
    path = sinks.scratch(spark, "log")
    assert lives(spark, path) == []
    seen = []
    first = tradelog.append(rows(spark, [1, 2, 2]), path)
    second = tradelog.append(rows(spark, [2, 3]), path, before_commit=lambda: seen.append(lives(spark, path)))
    assert seen == [[1, 2]] and lives(spark, path) == [1, 2, 3] and lives(spark, path, first) == [1, 2]
    assert tradelog.append(rows(spark, [1, 3]), path) == second  # nothing to add
    assert tradelog.compact(spark, path, SCHEMA) == second + 1 and lives(spark, path) == [1, 2, 3]


def test_a_repeated_batch_is_not_written_again(spark):
    path = sinks.scratch(spark, "log")
    assert [tradelog.append(rows(spark, [i]), path, f"closes:{n}") for i, n in ((1, 0), (2, 1), (9, 1), (9, 0), (3, 2))] == [1, 2, 2, 2, 3]
    assert lives(spark, path) == [1, 2, 3]
