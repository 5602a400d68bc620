import zlib

import numpy as np
import pyarrow as pa
import pytest

from veridra.llm import language_id as P
from veridra.llm import toxicity as X
from veridra.llm.registry import op3_language_id, op4_toxicity

SF = "/root/testdata/sf0.01"


def test_code_lengths_are_those_of_a_plain_ppm():
    """The tables against counts of raw bytes walked one by one; nothing of the model but its answers is read."""
    samples = {"a": [b"the cat sat on the mat", b"then"], "b": [b"der hund und die katze"], "c": ["Кот и пёс".encode(), "你好".encode()]}
    model = P.train(samples)
    counts = {}
    for lang, texts in samples.items():
        mine = counts[lang] = {}
        stream = b"".join(b"   " + t for t in texts)
        for n in range(1, 5):
            for i in range(n - 1, len(stream)):
                key = stream[i - n + 1 : i]
                mine.setdefault(key, {}).setdefault(stream[i], 0)
                mine[key][stream[i]] += 1

    def dist(lang, context):
        shorter = dist(lang, context[1:]) if context else {k: 1 / 256 for k in range(256)}
        seen = counts[lang].get(context)
        if not seen:
            return shorter
        n, d = sum(seen.values()), len(seen)
        left = sum(p for k, p in shorter.items() if k not in seen)
        return {k: seen[k] / (n + d) if k in seen else d / (n + d) * p / left for k, p in shorter.items()}

    for text in (b"the hat", b"katze", b"zzz qq", b"a", b"The 123 (CAT)!", "кот 你们 ñ".encode(), bytes(range(256))):
        s = b"   " + text
        want = [sum(-np.log2(dist(lang, s[i - 3 : i])[s[i]]) for i in range(3, len(s))) for lang in sorted(samples)]
        assert P.code_lengths(text, model) == pytest.approx(want, rel=1e-4)


def test_scripts_are_told_apart():
    samples = {"ru": ["кошка сидит на окне и смотрит на улицу".encode()], "uk": ["кішка сидить на вікні і дивиться на вулицю".encode()], "zh": ["我们今天去学校学习中文".encode()], "ja": ["私たちは今日学校で勉強します".encode()], "ar": ["القط يجلس على النافذة".encode()]}
    model = P.train(samples)
    for lang, text in {"ru": "на окне кошка", "uk": "на вікні кішка", "zh": "我们学习", "ja": "私たちは勉強", "ar": "على القط"}.items():
        assert P.predict(text, model)[0] == lang


def test_long_texts_are_scored_whole():
    model = P.train({"a": [b"the cat sat"], "b": [b"der hund"]})
    text = b"the cat " * 300_000
    parts = P.code_lengths(text, model)
    assert len(text) > P.CHUNK and parts[0] == pytest.approx(300_000 * (P.code_lengths(b"the cat " * 2, model) - P.code_lengths(b"the cat ", model))[0], rel=1e-3)


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(odd, none):
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in P.identify_languages(odd).collect()]
    assert len(rows) == odd.count()
    assert {r for r in rows if r[0] in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert P.identify_languages(none).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in P.identify_languages(unlabelled).collect()} == {"und"}


def ssk(a, b):
    """The kernel by its definition: all pairs of index triples."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), X.ORDER):
        for j in combinations(range(len(b)), X.ORDER):
            if [a[k] for k in i] == [b[k] for k in j]:
                total += X.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_is_the_definition():
    pairs = [("idiot", "idxiot"), ("moron", "moron"), ("abc", "xyz"), ("aabbcc", "abcabc"), ("ab", "abc")]
    a, b = X.coded([p[0] for p in pairs]), X.coded([p[1] for p in pairs])
    assert X.subsequence_kernel(a, b) == pytest.approx([ssk(*(f"\x02{w}\x03" for w in p)) for p in pairs], rel=1e-4)


def plain_kernel(a, b):
    """The normalised kernel of two words by the definition, to the power; small ones are 0."""
    a, b = f"\x02{a}\x03", f"\x02{b}\x03"
    value = ssk(a, b) / np.sqrt(ssk(a, a) * ssk(b, b))
    return value**X.POWER if value >= X.FLOOR else 0.0


def test_all_kernels_are_those_of_the_definition():
    """Misspelt and random words against landmarks, one by one: nothing that counts is passed over."""
    rng = np.random.default_rng(3)
    names = ["idiot", "stupid", "trash", "moron", "réeux"]
    words = [w for n in names for w in X.misspelt(n)] + ["idt", "stpd", "upid", "tra", "abc", "iii", "tarsh", "stupidity"]
    words += ["".join(rng.choice(list("idotsuprahmnéx"), rng.integers(3, 11))) for _ in range(150)]
    found = X.Machine(names).kernels(words)
    for word, row in zip(words, found):
        assert row == pytest.approx([plain_kernel(word, n) for n in names], rel=1e-3, abs=1e-6), word
    assert all(found[words.index(w)].max() > 0 for w in ("idt", "stpd", "upid", "tra"))


def test_scores_are_those_of_a_plain_machine():
    """A text's score is its highest sentence's: bias and weights times the kernels of the nearest units."""
    texts = ["You idiot! The weather is fine. Go home", "st up id things are s t u p i d", "no such words here\nstupidd idi.ot", "", "ixdxixoxt " * 3, "a b. c d"]
    machine = X.Machine(["idiot", "stupid"])
    machine.weights, machine.bias = np.array([0.7, 1.1]), -0.4
    want = []
    for text in texts:
        scores = [machine.bias]
        for sentence in X.sentences(text):
            words = [(w, 1) for u in sentence for w in X.windows(u)] + [(w, 2) for u in sentence for w in X.halves(X.windows(u))]
            nearest = [max((plain_kernel(w, n) ** times for w, times in words), default=0) for n in machine.names]
            scores.append(machine.bias + float(np.dot(machine.weights, nearest)))
        want.append(max(scores))
    assert X.Scorer(machine).margins([X.sentences(t) for t in texts]) == pytest.approx(want, rel=1e-3)
    assert want[1] > 0.5 and want[4] > 0.2


def test_units_alike_but_for_signs_are_computed_once(monkeypatch):
    """Nor are equal halves computed again, and nothing that earlier texts had; forgetting changes no score."""
    asked, plain = [], X.Machine.kernels
    monkeypatch.setattr(X.Machine, "kernels", lambda self, words: asked.extend(words) or plain(self, words))
    machine = X.Machine(["idiot", "stupid"])
    machine.weights, machine.bias = np.array([0.7, 1.1]), -0.4
    texts = ["idiot idiot, (idiot) ixdxixoxt. ixdxixoxt!", "stupid; idiot? stupid", "stuupid " * 40 + "s" * 50]
    asked.clear()
    scorer = X.Scorer(machine)
    found = [scorer.margins([X.sentences(t)])[0] for t in texts]
    assert len(asked) == len(set(asked)) and {"idiot", "xxxx", "stupid"} <= set(asked)
    assert [X.Scorer(machine, most=1).margins([X.sentences(t)])[0] for t in texts] == found == X.Scorer(machine).margins([X.sentences(t) for t in texts]).tolist()


def test_kernels_with_themselves_are_computed_once_a_pattern(monkeypatch):
    """Words whose characters are equal at the same places have the same norm, which is that of the definition."""
    asked = []
    for name in ("subsequence_kernel", "own_norms"):
        plain = getattr(X, name, None)
        monkeypatch.setattr(X, name, lambda *given, plain=plain: asked.append(len(given[0])) or plain(*given), raising=False)
    machine = X.Machine(["idiot", "stupid"])
    words = [f"i{a}i{b}t" for a in "dxqzk" for b in "owrs"] + [f"stu{a}{a}id" for a in "pxqk"] + ["idiidiidi", "ttttt"]
    asked.clear()
    found = [machine.kernels(words), machine.kernels(words[::-1])[::-1]]
    assert sum(asked) <= 5
    for word, row, again in zip(words, *found):
        assert row == pytest.approx([plain_kernel(word, n) for n in machine.names], rel=1e-3, abs=1e-6), word
        assert row == pytest.approx(again, rel=1e-6)


def test_kernels_do_not_depend_on_what_else_is_computed():
    rng = np.random.default_rng(4)
    machine = X.Machine(["idiot", "stupid", "moron", "pathetic"])
    words = ["".join(rng.choice(list("idotsupmrnahec"), n)) for n in (5, 9, 14) for _ in range(80)] + X.misspelt("pathetic") * 2
    together = machine.kernels(words)
    assert (together > 0).any() and np.array_equal(together, np.concatenate([machine.kernels([w]) for w in words]))


def plain_sentences(text):
    """Cut word by word, with what is joined across white space run by run."""
    words, found, at = text.lower().split(), [], 0
    while at < len(words):
        end = min(at + X.WORDS, len(words))
        if end < len(words):
            end = next((k for k in range(end, at + X.WORDS // 2, -1) if words[k - 1][-1] in ".!?"), end)
        found.append(words[at:end])
        at = end
    runs = [[]]
    for w in words:
        if len(w) <= X.FRAGMENT:
            runs[-1].append(w)
        elif runs[-1]:
            runs.append([])
    for run in runs:
        lone = "".join(w if len(w) == 1 else " " for w in run).split(" ")
        joined = [a + b for a, b in zip(run, run[1:])] + [x for x in lone if len(x) > 2]
        joined += [a + b + c for a, b, c in zip(run, run[1:], run[2:]) if max(len(a), len(b), len(c)) < 3]
        found += [joined[i : i + X.WORDS] for i in range(0, len(joined), X.WORDS)]
    return found


def test_texts_cut_together_are_those_cut_one_by_one():
    rng = np.random.default_rng(8)
    parts = ["a", "b", "st", "up", "id", "the", "you", "end.", "wow!", "q?", "\u0130", "\u0391\u03a3", "\u00e9.", "_", "...", "longerword", "idiot", "\u200b"]
    texts = ["".join(w + s for w, s in zip(rng.choice(parts, n), rng.choice([" ", " ", "\n", "\u3000", "\x1c", "\x85", "  "], n))) for n in rng.integers(0, 60, 400)]
    texts += ["", " \n", "s t u p i d", "a " * 40, "b"]
    want = [plain_sentences(t) for t in texts]
    assert [X.sentences(t) for t in texts] == want
    cut, got = X.cut(texts), [[] for _ in texts]
    for a, b, text in zip(cut.starts.tolist(), [*cut.starts.tolist()[1:], len(cut.places)], cut.text.tolist()):
        got[text].append([cut.units[n] for n in cut.places[a:b]])
    assert got == want


def test_portions_hold_every_row_once(monkeypatch):
    """Few texts or few characters at once, a long text alone; no row is lost and null is empty."""
    monkeypatch.setattr(X, "_TEXTS", 3)
    monkeypatch.setattr(X, "_CHARS", 10)
    texts = ["aaaa", None, "bbb", "c", "d" * 50, "", "e" * 9, "ff", "g", "h"]
    parts = list(X.portions(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])))
    assert [t for part, _ in parts for t in part.column("text").to_pylist()] == texts
    assert [x for _, x in parts] == [["aaaa", "", "bbb"], ["c"], ["d" * 50], ["", "e" * 9], ["ff", "g", "h"]]
    assert list(X.portions(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"]))) == []


def test_sentences_and_units():
    assert X.sentences("Several words. The end") == [["several", "words.", "the", "end"], ["theend"]]
    assert [len(s) for s in X.sentences("longer words " * 4 + "ended here. " + "longer words " * 7)] == [10, 12, 2]
    assert [len(s) for s in X.sentences("longer " * 30)] == [12, 12, 6]
    joined = [u for s in X.sentences("s  t\nu p i d and st up id") for u in s]
    assert joined.count("stupid") == 2
    assert X.windows("i.d-i_o!t") == ["idiot"] and X.halves(["iqdziko.t", "ixdxixox"]) == ["idiot", "qzk."] and X.windows("ab") == []
    assert [len(w) for w in X.windows("a" * 40)] == [X.WIDTH, 24] and X.windows("é") == []


def test_toxicity_held_out(spark):
    """Of texts with a plain insult nearly all are found; some labels stand on texts without any."""
    table = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in table.collect()}
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    plain = ("idiot", "stupid", "worthless", "pathetic", "scum", "moron", "trash", "loser", "clown", "disgusting")
    rows = [r for r in op4_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    bad, good = [r for r in rows if labels[r["doc_id"]]], [r for r in rows if not labels[r["doc_id"]]]
    insulting = [r for r in bad if any(w in texts[r["doc_id"]] for w in plain)]
    assert len(insulting) > 50 and np.mean([r["predicted"] for r in insulting]) > 0.95
    assert np.mean([r["predicted"] for r in bad]) > 0.85 and np.mean([r["predicted"] for r in good]) < 0.03


def test_toxicity_tolerates_gaps():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghlmnoprstu"), 7))
    clean = [" ".join(word() for _ in range(20)) for _ in range(60)]
    toxic = [" ".join([word() for _ in range(10)] + ["blockhead", "numskull"][: 1 + i % 2] + [word() for _ in range(10)]) for i in range(40)]
    scorer = X.Scorer(X.train(toxic, clean))
    p = lambda t: scorer.machine.probability(scorer.margins([X.sentences(t)])[0])
    for text in ("you blockhead", "b l o c k h e a d", "b  l\no c k h e a d", "b.l.o.c.k.h.e.a.d", "blocxkhead", "blocxkheaqd", "BLOCKHEAD!", "blockkhead", "blckhead", "bxlxoxcxkxhxexaxd", "bqlzokcvkjhwegapd"):
        assert p(text) >= 0.3, text
    for text in ("", "the head of the block", " ".join(word() for _ in range(50))):
        assert p(text) < 0.3, text


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (4, None), (5, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        rows = X.score_documents(odd, given).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert X.score_documents(none, given).count() == 0
    kept = X.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert X.drop_toxic(none, labels).count() == 0
