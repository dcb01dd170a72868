import random

import numpy as np
import pytest

from counterfact.llm.bpe_automaton import encode_and_decode
from counterfact.llm.queries import tokenizer_path
from counterfact.llm.token_packing import Layout, best_fit, pack_texts, read_segments, write_packed
from tests.llm.cases import edge_table, empty_table


def brute(sizes, length):
    rows, room = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [i for i, r in enumerate(room) if r >= sizes[piece]]
        if fits:
            at = min(fits, key=lambda i: room[i])
            rows[at].append(piece)
            room[at] -= sizes[piece]
        else:
            rows.append([piece])
            room.append(length - sizes[piece])
    return rows, sorted(room)


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        length = rng.choice([1, 5, 16, 37])
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(0, 60))], int)
        rows = best_fit(sizes, length)
        _, room = brute(sizes.tolist(), length)
        assert sorted(p for row in rows for p in row) == list(range(len(sizes)))
        assert sorted(length - int(sizes[row].sum()) for row in rows) == room


@pytest.mark.parametrize("layout", [Layout(), Layout(length=16, window=100)])
def test_round_trip(spark, tmp_path, layout):
    table = edge_table(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    write_packed(pack_texts(table, tokenizer_path(), layout=layout), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    for row in packed.collect():
        assert len(row["ids"]) == 4 * layout.length
        assert row["cu_seqlens"][0] == 0 and row["cu_seqlens"][-1] == row["n_used"] <= layout.length
        assert row["resets"] == row["cu_seqlens"][:-1] == [s["start"] for s in row["segments"]]
        padding = np.frombuffer(row["ids"], "<u4")[row["n_used"] :]
        assert (padding == layout.pad).all()
    pieces = {}
    for r in read_segments(packed).orderBy("id", "first_token").collect():
        before = pieces.get(r["id"], b"")
        assert len(before) == 4 * r["first_token"]
        pieces[r["id"]] = before + r["ids"]
    coded = encode_and_decode(table, tokenizer_path(), carry=["doc_id"]).collect()
    end = np.array([layout.end], "<u4").tobytes()
    assert pieces == {r["doc_id"]: bytes(r["ids"]) + end for r in coded}


def test_edges(spark):
    packed = pack_texts(edge_table(spark), tokenizer_path())
    assert sorted((r["id"] or 0) for r in read_segments(packed).where("first_token = 0").collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert pack_texts(empty_table(spark), tokenizer_path()).count() == 0
