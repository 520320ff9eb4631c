"""The edit and diff queries align all turns of a conversation."""

import random

import duckdb

from wordloom.plans import catalog, oracles


def test_all_turns(spark, tmp_path):
    rows = [(1, 3, "assistant", "d e"), (1, 0, "user", "a b"), (1, 2, "user", " c d"), (1, 1, "assistant", "a x"), (2, 0, "user", "alone"), (2, 1, "user", None), (3, 0, "system", "no")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.recording_id: (r.a_words, r.b_words) for r in catalog.spoken_turns(spark, str(tmp_path)).collect()}
    assert got == {1: (["a", "b", "c", "d"], ["a", "x", "d", "e"]), 2: (["alone"], [])}
    assert {r.recording_id: r.distance for r in catalog.edit_distance(spark, str(tmp_path)).collect()} == {1: 3.0, 2: 1.0}


def test_distance_against_plain_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(["a", "B", "b", "c", "d."], k=rng.randint(0, 12)))) for c in range(30) for t in range(rng.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c in {r[0] for r in rows}:
        a, b = ([w.lower() for r in sorted(rows) if r[0] == c and r[2] == role for w in r[3].split()] for role in ("user", "assistant"))
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                row[j], last = min(row[j] + 1, row[j - 1] + 1, last + (w != v)), row[j]
        if a or b:
            want[c] = row[-1]
    assert {r.recording_id: r.distance for r in catalog.edit_distance(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert dict(con.execute(oracles.SLOW["edit_distance"]).fetchall()) == want
