import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from counterfact.llm import bpe_automaton
from counterfact.llm.bpe_automaton import SpecialSplit, compile_tokenizer, decode_ids, encode_and_decode, encode_texts
from counterfact.llm.queries import tokenizer_path
from tests.llm.cases import edge_rows, edge_table, empty_table

LIBRARY = Tokenizer.from_file(tokenizer_path())
AUTOMATON = compile_tokenizer(tokenizer_path())


def check(texts):
    ids, bounds = encode_texts(pa.array(texts, pa.string()), AUTOMATON, SpecialSplit(AUTOMATON.specials))
    decoded = decode_ids(ids, bounds, AUTOMATON.labels).to_pylist()
    for k, text in enumerate(texts):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, text
        assert decoded[k] == LIBRARY.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("alphabet", ["ab", "ahlo!?.", "abcdefghijklmnopqrstuvwxyz", "abAB' .,!?0123é́ß\n\t<|>#日本ñœ🏽👍‍"])
def test_random_strings_equal_the_library(alphabet):
    rng = random.Random(5)
    check(["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)])


def test_particular_strings():
    check(
        [
            None,
            "",
            "a" * 300,
            "Hello, World's 123 end!!! it's ΣΑΣ İstanbul ﬁ é é J̌ \x1c a\x1db  x y",
            "<|endoftext|>x<|startoftext|> <| endoftext|> <|ENDOFTEXT|> a<|endoftext|>",
            "😀😀 日本語 ʼs ’s  x y﻿",
            "\x00\x7f￿",
            *[r[1] for r in edge_rows()],
        ]
    )


def long_words():
    """Words of thousands of letters: drawn, with runs of one letter and repeated stretches, and nothing but a run."""
    rng = random.Random(11)
    letters = "etaoinshrdlucmfgypwbvkxjqz"
    drawn = "".join(rng.choices(letters, range(26, 0, -1), k=23_000))
    runs = "".join(rng.choice(letters) * rng.randint(1, 700) for _ in range(60))
    again = "".join(rng.choices(letters, k=37)) * 500
    signs = "".join(rng.choices("+/=-_.#", k=9_000))
    return [drawn, runs, again, signs, "a" * 12_345, "ab" * 6_000, "日本語" * 2_500]


def test_long_words_equal_the_library():
    check([*long_words(), " ".join(["short", *long_words()[:3], "words", "between", long_words()[3]])])


@pytest.mark.parametrize("piece, overlap", [(64, 80), (100, 30), (7, 200), (1, 1)])
def test_pieces_of_any_size_equal_the_library(monkeypatch, piece, overlap):
    """Also where they are too small to meet, so that a word is encoded in one."""
    monkeypatch.setattr(bpe_automaton, "PIECE", piece)
    monkeypatch.setattr(bpe_automaton, "OVERLAP", overlap)
    check([w[:1500] for w in long_words()] + ["plain words here", "", None, "hello " * 50])


def test_a_megabyte_without_a_space():
    """Time follows the length, not its product with anything."""
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begun = time.perf_counter()
    check([text])
    assert time.perf_counter() - begun < 60


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=30))
def test_any_text_equals_the_library(text):
    check([text])


def test_a_state_has_the_arcs_of_encodings_only():
    """A token may follow another if and only if their joined text is encoded as these two."""
    rng = np.random.default_rng(2)
    inner = [k for k in range(49406) if not AUTOMATON.labels[k].as_py().decode().rstrip(" ").endswith("</w>")]
    p, x = rng.choice(inner, 400), rng.choice(inner, 400)
    follows = AUTOMATON.follows(p, x)
    for a, b, yes in zip(p.tolist(), x.tolist(), follows.tolist()):
        text = (AUTOMATON.labels[a].as_py() + AUTOMATON.labels[b].as_py()).decode().replace(" ", "")
        tokens = [t.id for t in LIBRARY.model.tokenize(text + "a")]
        if yes:
            continue
        assert tokens[:2] != [a, b] or len(tokens) < 2


def test_query_equals_the_library(spark):
    rows = entry.queries()["op8_bpe"](spark, entry.ENTRY_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{entry.ENTRY_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_edges(spark):
    out = encode_and_decode(edge_table(spark), tokenizer_path())
    rows = out.collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["n_tokens"] for k in (1, 2, 3)] == [0, 0, 0] and by[1]["decoded"] == ""
    assert encode_and_decode(empty_table(spark), tokenizer_path()).count() == 0
