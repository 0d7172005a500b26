"""Counts of prefixes, held against the library on every prefix."""

import json

import pytest
from pyspark.sql import functions as F
from tests.llm.test_exact import BYTE, ODD, WORD, documents, fuzz, library
from tokenizers import Tokenizer

from quire.llm import prefix
from quire.llm.words import WordEncoder, splitting, vocabulary

PATH = vocabulary(BYTE)
CASES = ["a\n\nb  c", "  lead", "trail  ", "a \n b", "\n", "x\n", "we'll they're I've it's don't 'll ''re", "..<|endoftext|>.. <|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>", "<|endoftex", "\t\t x 　y", "\x1c \x1d a", "été. Où?", "12 345,67", "--------" * 9, "ab" * 90]


def library_counts(text, t=Tokenizer.from_file(PATH)):
    return [len(x.ids) for x in t.encode_batch([text[: i + 1] for i in range(len(text))], add_special_tokens=False)]


@pytest.mark.parametrize("most", [50, 300_000])
def test_every_prefix(most):
    made = prefix.PrefixCounter(PATH, most)
    for text in [*CASES, *(x[:200] for x in ODD if x), *fuzz(11, 1500)]:
        assert prefix.counts(made.steps(text)).tolist() == library_counts(text), text
    assert made.steps(None) == made.steps("") == b""


def test_long_texts():
    made, ids = prefix.PrefixCounter(PATH), library(BYTE)
    for text in ["word " * 30_000, "x" * 20_000, "中文" * 5_000, " " * 5_000, "a\n" * 5_000]:
        counted = prefix.counts(made.steps(text))
        assert len(counted) == len(text)
        for at in (1, 7, len(text) // 3, len(text)):
            assert counted[at - 1] == len(ids(text[:at]))


def test_answers():
    made = prefix.PrefixCounter(PATH)
    for text in [*CASES, *fuzz(12, 200)]:
        steps, counted = made.steps(text), library_counts(text)
        for limit in (0, 1, 3, 1000):
            assert prefix.longest(prefix.counts(steps), limit) == max([i + 1 for i, n in enumerate(counted) if n <= limit], default=0)
        parts = prefix.slices(steps, 3)
        assert "".join(text[a:b] for a, b in parts) == text
        for a, b in parts:
            assert b == a + 1 or counted[b - 1] - (counted[a - 1] if a else 0) <= 3


def test_query(spark):
    texts, ids = [*ODD, *CASES], library(BYTE)
    docs = documents(spark, texts, True).withColumn("steps", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in prefix.count_tokens(docs, BYTE, limit=5).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(ids(text))
        assert tuple(got[i])[:4] == (i, len((text or "").encode()), n, n > 5)
        assert got[i]["limit_chars"] == max([k + 1 for k, x in enumerate(library_counts((text or "")[:400])) if x <= 5], default=0)
    cut = {r["doc_id"]: r["truncated"] for r in prefix.truncated(docs, BYTE, 5).collect()}
    assert all(cut[i] == (None if t is None else t[: got[i]["limit_chars"]]) for i, t in enumerate(texts))
    assert prefix.count_tokens(docs.limit(0), BYTE).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "x"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in prefix.count_tokens(same, BYTE).collect()) == [(False, 0), (False, 1), (True, 2), (True, 2)]


def test_other_vocabularies_are_refused(tmp_path):
    """What isn't known to be cut rightly raises, and isn't encoded wrongly."""
    assert (splitting(PATH), splitting(vocabulary(WORD))) == ("spaced", "lowered")
    with pytest.raises(ValueError, match="byte-level"):
        prefix.PrefixCounter(vocabulary(WORD))
    told = json.loads(open(PATH, encoding="utf-8").read())
    plain = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, " ": 2}, "merges": []}}
    changes = [{"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": told["model"] | {"ignore_merges": True}}, {"model": told["model"] | {"dropout": 0.1}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}]
    for i, other in enumerate([plain, *(told | c for c in changes)]):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        for make in (WordEncoder, prefix.PrefixCounter):
            with pytest.raises(ValueError, match="can't be cut"):
                make(str(path))
