"""The toxicity channel: all readings of short units, doubled letters, spaced words and long chunks."""

import itertools
import random
import time

import numpy as np
import pytest

from scrivia.llm import toxicity


def trigrams(*words):
    n = np.full((28, 28, 28), -6.0, np.float32)
    for word in words:
        k = [0, 0, *[ord(c) - 96 for c in word], 0]
        for a, b, c in zip(k, k[1:], k[2:]):
            n[a, b, c] = -0.5
    return n.tobytes()


def test_doubled_letters_are_decoded():
    restorer = toxicity.Restorer(trigrams("idiot", "moron", "stupid", "letter"))
    for written, word in [("idiiot", "idiot"), ("stuupid", "stupid"), ("mooron,", "moron"), ("IIdiot", "idiot")]:
        assert word in restorer.readings(written), written
    assert set(restorer.readings("letter")) == {"letter"}
    # where the doubled reading is likelier, the lexicon still knows the word, and how it begins
    lexicon = dict.fromkeys(toxicity.word_features("moron"), 1.0)
    features = toxicity.Features(trigrams("mooron"), lexicon)
    assert features("a mooron") == set(lexicon) and not features("maroon")
    assert features("mooronic")


def test_spaced_words_are_parted():
    restorer = toxicity.Restorer(trigrams("idiot", "stupid", "you", "moron"))
    for written, words in [
        ("y o u i d i o t", {"you", "idiot"}), ("s t u p i d  m o r o n", {"stupid", "moron"}), ("i d  i o t", {"idiot"}),
        ("an i\nd\ni\no\nt", {"idiot"}), ("i. d. i. o. t.", {"idiot"}), ("i - d - i - o - t", {"idiot"}), ("\u00a1 d 1 0 t", {"idiot"}),
    ]:
        assert words <= set(restorer.spaced(written)), written
    lexicon = dict.fromkeys(toxicity.word_features("idiot"), 1.0)
    assert toxicity.Features(trigrams("youidiotx"), lexicon)("y o u i d i o t x") == set(lexicon)
    assert restorer.spaced("a b") == restorer.spaced("plain words, of more letters") == []


def test_long_chunks_are_decoded():
    restorer = toxicity.Restorer(trigrams("idiot"))
    chunk = ".".join(["idiot"] * 12) + ".i.d.i.o.t"
    assert len(chunk) > toxicity.LONGEST_KEPT and restorer.readings(chunk)[-1] == "idiot" * 13
    assert len(restorer.viterbi("i1" * 50_000)) > 0  # time in proportion


def readings_of(unit, logs):
    """Every text that a unit may read as, with its best score, by trying all choices."""
    choices = []
    for i, c in enumerate(unit):
        own = [(r, toxicity.COST_READ) for r in toxicity.READINGS[c]] if c in toxicity.READINGS else [(c, 0.0)] if c.isalpha() else []
        if c in toxicity.SEPARATORS or not own:
            own = [*own, ("", toxicity.COST_SKIP)]
        elif i and unit[i - 1] == c:
            own = [*own, ("", toxicity.COST_REPEAT)]
        choices.append(own)
    best = {}
    for path in itertools.product(*choices):
        text = "".join(letter for letter, _ in path)
        kinds = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in text)]
        score = sum(logs[a][b][c] for a, b, c in zip(kinds, kinds[1:], kinds[2:])) - sum(cost for _, cost in path)
        best[text] = max(best.get(text, -1e9), score)
    return best


def test_viterbi_finds_the_best_of_all_readings():
    rng = random.Random(7)
    for trial in range(400):
        if trial % 40 == 0:
            logs = np.random.default_rng(trial).normal(-3, 2, (28, 28, 28)).astype(np.float32)
            restorer = toxicity.Restorer(logs.tobytes())
        unit = "".join(rng.choice("aabeilost10!|$6.-_3é") for _ in range(rng.randint(1, 7)))
        every = readings_of(unit, logs.tolist())
        assert every[restorer.viterbi(unit)] == pytest.approx(max(every.values()), abs=1e-6), unit


def test_edges_and_classes():
    for chunk, core in [("..,id!ot?!", "id!ot"), ("$$money", "money"), ("!!", ""), ("...", ""), ("(id10t)", "(id10t"), ("***a!!!", "a"), ("", ""), ("((a", "a"), ("_x_", "_x_"), ("a", "a")]:
        assert toxicity.bare(chunk) == core, chunk
    assert [toxicity._class_of[c] for c in "aZ.é日“😀"] == [1, 26, 0, 27, 27, 0, 0]
    # the model counts a character as what it is asked for
    import pyarrow as pa

    counted = next(iter(toxicity._count_trigrams(iter([pa.record_batch([pa.array(["日b", None, ""])], ["text"])]))))
    assert counted.to_pydict() == {"gram": [27, 27 * 28 + 2, 2 * 28 * 28, (27 * 28 + 2) * 28], "n": [1, 1, 1, 1]}


def test_a_million_signs_take_time_in_proportion():
    restorer = toxicity.Restorer(trigrams("idiot"))
    for text in ("!" * 10**6 + "a", "a" + "?" * 10**6, "!?" * 500_000, "." * 10**6):
        began = time.time()
        restorer.readings(text)
        assert time.time() - began < 20


def test_trigrams_of_long_texts_are_all_counted(monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["the quick brown fox. " * 9, "é日x"])], ["text"])
    whole = next(iter(toxicity._count_trigrams(iter([batch])))).to_pydict()
    monkeypatch.setattr(toxicity, "CODES_TOGETHER", 7)
    assert next(iter(toxicity._count_trigrams(iter([batch])))).to_pydict() == whole
