"""The packer with few open windows allowed: the fullest are retired, nothing is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from auditweave.llm import bpe
from auditweave.llm.packing import Packer


@pytest.mark.parametrize("seed", range(4))
def test_retiring_keeps_every_id_and_the_other_windows(seed):
    rng = np.random.default_rng(seed)
    packer, docs, placed, most = Packer(window=16, most_open=6), [], [], 0
    for n in range(400):
        ids = rng.integers(0, 1000, rng.choice([1, 7, 9, 11, 13, 15, 40]))
        docs.append(ids)
        before = packer.n_open
        placed += packer.add(n, ids)
        most = max(most, packer.n_open)
        if packer.n_open < before - 1 and before > 4:
            assert 1 <= packer.n_open <= 3  # about half stay open
        assert packer.n_open == sum(map(len, packer.open)) == packer.counts.sum() <= 6
    placed += packer.close()
    assert packer.n_open == 0 and most <= 6
    for n, ids in enumerate(docs):
        own = sorted((start, piece.tolist()) for (doc, start, piece), _, _ in placed if doc == n)
        assert [x for _, piece in own for x in piece] == ids.tolist() and all(a + len(p) == b for (a, p), (b, _) in zip(own, own[1:]))
    windows = {}
    for (_, _, piece), sequence, at in placed:
        assert at == windows.get(sequence, 0)
        windows[sequence] = at + len(piece)
    assert max(windows.values()) <= 16 and sum(v < 16 for v in windows.values()) <= 1


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    """One by one, or by few texts, the steps of merging cost more than the words; the ids are those of single words."""
    rng, calls, batch = np.random.default_rng(1), [], bpe.Merger.batch
    monkeypatch.setattr(bpe.Merger, "batch", lambda self, words: (calls.append(words), batch(self, words))[1])
    texts = [" ".join("".join(rng.choice(list("abcdeéß7_𝔘İ"), rng.integers(1, 60))) for _ in range(6)) for _ in range(500)]
    encoder = bpe.Encoder(bpe.default_vocabulary())
    got = [[x for ids in entries for x in ids] for entries in encoder.entries(texts)]
    assert len(calls) == 1
    assert got == [[x for run in t.split() for w in bpe.words_of(run) for x in encoder.merge.ids(w)] for t in texts]


ATOMS = ["a", "A", "h", "H", "J", "I", "T", "\u0331", "\u0307", "\u030a", "\u0338", "\u0301", "'", "'s", "'S", "'re", "'LL", "'t", "é", "É", "ß", "×", "÷", "ü", ".", ",", "!", "<", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|startof", "text|>", "1", "23", "²", "½", "٣", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "“", "…", "漢", "한", "\u1112\u1161", "ΑΣ", "İ", "ŉ", "ẞ", "ﬁ", "𝔘", "😀", "_", "the", "Hello", "\x00", "\u200b", "a" * 60, "\xad", "Ⅷ", "ª"]


@pytest.mark.parametrize("at_once, memo", [(1 << 22, 250_000), (500, 100)])
def test_texts_cut_together_have_the_ids_of_each_alone(monkeypatch, at_once, memo):
    monkeypatch.setattr(bpe, "MOST_BYTES", at_once)
    monkeypatch.setattr(bpe, "MEMO_WORDS", memo)
    rng, whole = random.Random(1), Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["".join(rng.choices(ATOMS, k=rng.randint(0, 30))) for _ in range(6000)] + ["", None, "   ", "x" * 5000, "<|startof", "text|>", "e", "\u0301", None]
    encoder = bpe.Encoder(bpe.default_vocabulary())
    for kind in (pa.string(), pa.large_string()):
        got = [ids.tolist() for ids in encoder.documents(pa.array(texts, kind).slice(2))]
        assert got == [x.ids for x in whole.encode_batch([t or "" for t in texts[2:]], add_special_tokens=False)]
    assert list(encoder.documents(pa.array([], pa.string()))) == []


def test_what_is_learnt_grows_with_words_and_not_with_what_they_stand_beside():
    words, marks = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)], [a + b for a in "$#%*&!" for b in "$#%*&!;?"]
    encoder = bpe.Encoder(bpe.default_vocabulary())
    assert len(list(encoder.documents(pa.array([" ".join(w + m for w in words) + f" {7 * n:04d}" for n, m in enumerate(marks)])))) == len(marks)
    assert len(encoder.pieces) <= len(words) + len(marks) + 10  # whole runs: nearly 10,000
