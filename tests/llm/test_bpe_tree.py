import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from routelens.llm import bpe_tree

PATH = public_tokenizers.path(bpe_tree.RANKS)
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = bpe_tree.TreeBPE(PATH, leaf_chars=3)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é's'llre 12.,!?\n\t  ßñ語<|>endoftext \U0001f600"), max_size=60))
def test_tree_equals_library(text):
    ids = TREE.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert TREE.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" '.,sdtrem1²½٣\n\u3000\xa0\x1c\x85"), st.characters(codec="utf-8")), max_size=40))
def test_tree_equals_library_on_any_characters(text):
    ids = TREE.encode(text)
    assert ids == PLAIN.encode_ordinary(text) and TREE.decode(ids) == text.encode()


@given(st.text(alphabet=st.one_of(st.sampled_from(" '.,sdtrem1²½٣\n\u3000\xa0\x1c\x85"), st.characters(codec="utf-8")), min_size=2, max_size=20))
@settings(max_examples=400, deadline=None)
def test_nothing_changes_beyond_a_point_where_matches_end(text):
    for i in range(1, len(text)):
        if bpe_tree._sync(text, i):
            assert PLAIN.encode_ordinary(text) == PLAIN.encode_ordinary(text[:i]) + PLAIN.encode_ordinary(text[i:])


def test_windows_stay_small_in_other_scripts():
    rng = random.Random(3)
    for letters, marks in (("абвгдежзиклмн", " ,. "), ("語学中文字漢", "，。"), ("αβγδεζ", " "), ("אבגדה", " .")):
        text = "".join(rng.choice(letters) if rng.random() < 0.85 else rng.choice(marks) for _ in range(60_000))
        tree = bpe_tree.TreeBPE(PATH)
        seen, leaf = [], tree.leaf
        tree.leaf = lambda t, leaf=leaf, seen=seen: seen.append(len(t)) or leaf(t)
        assert tree.encode(text) == PLAIN.encode_ordinary(text)
        assert sum(seen) < 1.3 * len(text)  # leaves are the text once; windows add little


def test_long_text_without_spaces():
    for text in ("a" * 5000, "語" * 3000, " " * 3000, "ab " * 4000, "1234567" * 500):
        tree = bpe_tree.tokenizer(PATH)
        assert tree.encode(text) == PLAIN.encode_ordinary(text)


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello world, it's"), (3, "Hello world, it's"), (4, "née " * 700)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe_tree.digest_documents(docs, PATH).collect()
    assert len(got) == 5
    text = {i: t or "" for i, t in rows}
    for r in got:
        ids = PLAIN.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe_tree.digest_documents(docs.limit(0), PATH).count() == 0
