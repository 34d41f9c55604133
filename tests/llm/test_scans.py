from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import scans as S
from foliant.llm.lexicon import Trie, prefixes, swaps

WORDS = st.text(alphabet="abcé가", min_size=1, max_size=6)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(WORDS, max_size=30), WORDS, st.integers(0, 3))
def test_retrieval_is_complete(words, word, most):
    from foliant.llm.lexicon import letters

    got = dict(Trie(words).within(word, most))
    assert got == {w: distance(letters(word), letters(w)) for w in words if distance(letters(word), letters(w)) <= most}


def test_lookalikes():
    for seen, meant in [("c0unter", "counter"), ("perrnit", "permit"), ("conceme", "concerne"), ("brancli", "branch"), ("dccernber", "december"), ("기록브관소는", "기록보관소는")]:
        assert swaps(seen, meant, S._ALIKE, 3)
    for seen, meant in [("teh", "the"), ("rport", "report"), ("dog", "cat")]:
        assert not swaps(seen, meant, S._ALIKE, 2)


def answers(words, vocabulary):
    """What _answers says, on one trie: True for known words, else the words that look like it."""
    trie, out = Trie(vocabulary), {}
    for w in words:
        if w in vocabulary:
            out[w] = True
        elif S.can_be_misread(w):
            found = trie.alike(w, S._MEANT, S._reach(w)[-1])
            out[w] = [(o, n, 9) for o, n in found if n <= (2 if any(n <= 2 for _, n in found) else 3)]
    return out


def test_read():
    words = frozenset("the counter of percent above every plan stays open half finished after first".split())
    text = "Thc c0unter of per- \r\ncent above every\n\n- 12 -\nMy Plan 2019 XY-12  Chapter 3\n\nplan stays open after half-\nfinished first.\n\nThe plan."
    for head in (words, frozenset()):  # the head only saves joins
        furniture, lines = S.without_furniture(text, "my plan 2019 xy-12", frozenset())
        asked = [w for w in S.asked_words(lines) if w not in head]
        noise, out = S.Reader(head, np.zeros(1 << 8, np.uint8)).read(lines, answers(asked, words))
        assert noise | furniture == set(S.NOISE)
        assert out == "The counter of percent above every plan stays open after half-finished first.\n\nThe plan."


def scan_rows():
    body = "The counter of the long printed plan was open after the audit and the\nofficer kept every paper about the plan in the old folder of the\ndepot for the purchasing office and the print room of the whole yard and\nfor the next audit."
    rows = [(f"c{i}", f"d{i % 40}", "Other.txt", body.replace("\n", " "), 1) for i in range(120)]
    rows += [("s1", "scan", "Plan A.pdf", body.replace("counter", "c0unter"), 1), ("s2", "scan", None, "Plan A\n" + body.replace("depot", "de-\npot"), 1), ("s3", "scan", "Plan A.pdf", body + "\nxii", 1)]
    return rows + [("s1", "scan", "Plan A.pdf", body.replace("counter", "c0unter"), 2), ("n", "scan", "Plan A.pdf", None, 1), ("e", None, None, "", 1)]


def test_tables(spark):
    schema = "chunk_id string, doc_id string, docnm_kwd string, content string, noise int"
    df = spark.createDataFrame(scan_rows(), schema)
    assert {tuple(r) for r in S.noise_found(df).collect()} == {("s1", "misread"), ("s2", "running_header"), ("s2", "hyphenation"), ("s3", "page_number")}
    out = {r["chunk_id"]: r for r in S.repaired(df).collect()}
    assert len(out) == 125 and out["c1"]["content"] == scan_rows()[1][3] and out["n"]["content"] is None and out["e"]["content"] == ""
    assert "counter" in out["s1"]["content"] and "depot" in out["s2"]["content"] and "\n" not in out["s3"]["content"]
    assert S.noise_found(df.limit(0)).count() == 0 and S.repaired(df.limit(0)).count() == 0


def test_words_that_scans_use_more(spark):
    counts = {"retention": (3, 30), "folder": (400, 90), "foldcr": (3, 7), "교육이수증": (0, 30), "rnorgen": (0, 4), "morgen": (2, 20), "budget": (50, 1), "buclget": (3, 9)}
    counted = spark.createDataFrame([(w, *c) for w, c in counts.items()], "word string, clean bigint, scanned bigint")
    asked = spark.createDataFrame([(w,) for w in [*counts, "foldcr", "retentian", "qqqqq", "x"]], "word string")
    got = {r["word"]: True if r["known"] else {(x["other"], x["n"]) for x in r["found"]} for r in S._answers(asked, counted).collect()}
    assert got == {w: True for w in counts if w not in ("foldcr", "rnorgen")} | {"foldcr": {("folder", 1)}, "rnorgen": {("morgen", 1)}, "retentian": {("retention", 1)}}
    assert S.whole_words("Quill0n stays of per-\ncent, half-finished") == {"stays", "of", "half", "finished"}


def test_a_rare_word_stays_known_in_a_larger_corpus(spark):
    """Unrelated chunks, fifty times as many, change nothing."""
    schema = "chunk_id string, doc_id string, docnm_kwd string, content string, noise int"
    rows = [(c, d, n, t + " In certificate." if c in ("c1", "c2", "c3") else t.replace("depot", "certlficate") if c == "s1" and t else t, x) for c, d, n, t, x in scan_rows()]
    more = [(f"u{i}", f"u{i % 700}", "Notes.txt", f"Entirely other matter number {i} about shipping lanes and harbours.", 1) for i in range(6_000)]
    few, many = (sorted(tuple(r) for r in S.noise_found(spark.createDataFrame(x, schema)).collect()) for x in (rows, rows + more))
    assert few == many and ("s1", "misread") in few


def test_misread_of_a_word_that_scans_use_more(spark):
    rows = scan_rows()
    rows = [(c, d, n, t + " In certificate." if c in ("c1", "c2", "c3") else t, x) for c, d, n, t, x in rows]
    body = next(t for c, _, _, t, _ in rows if c == "s3").removesuffix("\nxii")
    rows += [(f"m{i}", "scan", "Plan A.pdf", body + " In certificate.", 1) for i in range(9)] + [("m9", "scan", "Plan A.pdf", body + " In certlficate.", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, docnm_kwd string, content string, noise int")
    assert {tuple(r) for r in S.noise_found(df).collect() if r["chunk_id"][0] == "m"} == {("m9", "misread")}


def test_chunk_without_noise_is_reflowed(spark):
    body = next(t for c, _, _, t, _ in scan_rows() if c == "s3").removesuffix("\nxii")
    rows = [*scan_rows(), ("s4", "scan", "Plan A.pdf", body + "\n\nThe depot.", 1)]
    out = {r["chunk_id"]: r for r in S.repaired(spark.createDataFrame(rows, "chunk_id string, doc_id string, docnm_kwd string, content string, noise int")).collect()}
    assert out["s4"]["noise"] == [] and out["s4"]["content"] == body.replace("\n", " ") + "\n\nThe depot."


def test_head_line_in_two_chunks_of_each_file(spark):
    body = next(t for c, _, _, t, _ in scan_rows() if c == "s3").removesuffix("\nxii")
    rows = scan_rows() + [(f"f{i}{j}", f"f{i}", "Other.pdf", f"{body}\n\nAlpha Beta Gamma\nDepot {'yx'[j]} was open.\n" + "- 12 -" * j, 1) for i in range(1500) for j in (0, 1)]
    rows = [(c, d, n, t if c[0] != "f" or c[-1] == "0" else "The yard.\n" + t[t.index("Alpha") :] + "\n\n" + body, x) for c, d, n, t, x in rows]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, docnm_kwd string, content string, noise int")
    assert S.noise_found(df).where("noise = 'running_header' and chunk_id like 'f%'").count() == 3000


def test_two_exchanges_of_two_letters():
    words = ("modern", "window", "other")
    assert answers(["rnoclern", "vvinclow", "rnodern", "modern"], words) == {"rnoclern": [("modern", 2, 9)], "vvinclow": [("window", 2, 9)], "rnodern": [("modern", 1, 9)], "modern": True}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="rnmcldaivw", min_size=3, max_size=7), st.integers(0, 3), st.integers(1, 4))
def test_every_reachable_prefix_is_found(word, most, length):
    """What swaps can make of a word begins with one of its prefixes."""
    reach = {word}
    for _ in range(most):
        reach |= {w[:i] + other + w[i + x :] for w in list(reach)[:400] for i in range(len(w)) for x in (1, 2) for other in S._MEANT.get(w[i : i + x], ())}
    found = prefixes(word, S._MEANT, most, length)
    assert {w[:length] for w in list(reach)[:2000] if swaps(word, w, S._ALIKE, most) is not None} <= found


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="rnmclda", min_size=1, max_size=6), max_size=30), st.text(alphabet="rnmclda", min_size=1, max_size=6), st.integers(0, 3))
def test_alike_is_complete(words, word, most):
    want = {w: n for w in words if w != word and (n := swaps(word, w, frozenset((s, m) for s in S._MEANT for m in S._MEANT[s]), most))}
    got = dict(Trie(words).alike(word, S._MEANT, most))
    assert want.items() <= got.items() and word not in got


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="rnmclduü1h가", min_size=1, max_size=7), max_size=30), st.lists(st.text(alphabet="rnmclduü1h가", min_size=1, max_size=7), max_size=4), st.integers(0, 3))
def test_automata_in_arrays_are_complete(words, asked, most):
    """Every word within the distance is found, those that no exchange explains too, and each prefix that leads to one is reached."""
    from foliant.llm.lexicon import letters

    trie, got = Trie(words), {}
    for places, nodes, edits in trie.near(asked, most, S._MEANT):
        got |= {(int(i), trie.word[node]): int(n) for i, node, n in zip(places, nodes, edits)}
    within = {(i, w): n for i, a in enumerate(asked) for w in words if (n := distance(letters(a), letters(w))) <= most}
    assert within.keys() <= got.keys() and all(got[k] <= n for k, n in within.items())
    assert {k for k, n in got.items() if n == 0} == {k for k, n in within.items() if n == 0}
    assert {(i, w) for i, a in enumerate(asked) for w in words if swaps(a, w, S._ALIKE, most) is not None} <= got.keys()
    begun = Trie({letters(w)[:2] for w in words})
    reached = {(int(i), begun.word[node]) for places, nodes, _ in begun.near(asked, most, S._MEANT, open_ended=True) for i, node in zip(places, nodes)}
    assert {(i, letters(w)[:2]) for i, w in got} <= reached


def test_longer_words_than_a_machine_word():
    word = "rnodern" * 20
    found = {trie.word[node]: int(n) for trie in [Trie([word.replace("rn", "m", 1), word[1:], word + "abc", word])] for _, nodes, edits in trie.near([word], 2, S._MEANT) for node, n in zip(nodes, edits)}
    assert found == {word: 0, word[1:]: 1, word.replace("rn", "m", 1): 1}


def test_characters_misread_twice(spark, monkeypatch):
    """Words within the distance of the automaton that no single exchange of a stretch leads to; however the vocabulary is dealt."""
    meant = {"l0boratory": "laboratory", "tedinician": "technician", "slirvey": "survey", "branc1i": "branch", "foldcr": "folder"}
    words = [*meant.values(), "certificate", "report", "folders"]
    counted = spark.createDataFrame([(w, 90, 9) for w in words], "word string, clean bigint, scanned bigint")
    asked = spark.createDataFrame([(w,) for w in [*meant, "rport", "reprot", "tecnician", "laboratory"]], "word string")
    for prefixes_, of_trie, at_once in [(50_000, 50_000, 200_000), (2, 1, 3)]:
        monkeypatch.setattr(S, "MOST_PREFIXES", prefixes_)
        monkeypatch.setattr(S, "TRIE_WORDS", of_trie)
        monkeypatch.setattr(S, "ASKED_WORDS", at_once)
        got = [(r["word"], r["other"]) for r in S.look_alikes(asked, counted).collect()]
        assert sorted(got) == sorted(meant.items())


def test_parts_of_a_vocabulary():
    assert S._parts([("a", 3), ("b", 2), ("c", 12), ("d", 1), ("e", 5)], 5) == [("a", 0, 1), ("b", 0, 1), ("c", 1, 3), ("d", 4, 1), ("e", 5, 1)]
    assert S._parts([], 5) == []
