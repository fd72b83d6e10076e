"""Near duplicates, repeated passages, personal data, and the whole pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pressmill.llm import near_duplicates as nd
from pressmill.llm import passages, pii
from pressmill.llm.components import components
from pressmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def some_words(r, n):
    return [f"{r.choice('abcdefgh')}{r.randint(0, 99999)}" for _ in range(n)]


def plain_classes(texts, least=0.8):
    """Classes by Jaccard similarity of word 5-shingles over all pairs; copies whatever their length."""
    name = list(range(len(texts)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            both = len(sets[i] | sets[j])
            if a is not None and b is not None and (a == b or both and len(sets[i] & sets[j]) / both >= least):
                name[find(i)] = find(j)
    return Counter(frozenset(k for k in range(len(texts)) if find(k) == root) for root in {find(k) for k in range(len(texts))})


def test_longest_common_and_similarity():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want = table[-1][-1]
        assert nd.longest_common(a, b, len(a) + len(b)) == want if a else nd.longest_common(a, b, 3) == 0
        got, exact = nd.similarity(np.array(a, np.uint64), np.array(b, np.uint64)), want / max(len(a) + len(b) - want, 1)
        assert got == (pytest.approx(exact) if exact >= 0.8 else 0.0)


def test_occurrences_are_told_apart():
    k = nd.labelled(np.array([5, 6, 5, 5, 6], np.uint64))
    assert len(set(k.tolist())) == 5 and k[0] == 5 and k[1] == 6


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 130)] + [(200 + k, 201 + k) for k in range(20)]
    name = {x: x for pair in links for x in pair}
    for _ in name:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in name.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_all_pairs(spark):
    r = random.Random(7)
    texts = [None, None, "", "", "one two", "one two", "one  two"]
    for _ in range(12):
        base = some_words(r, r.randint(5, 220))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            w = list(base)
            for _ in range(max(1, round(len(w) * r.choice([0.005, 0.01, 0.05])))):
                w[r.randrange(len(w))] = some_words(r, 1)[0]
            texts.append(" ".join(w))
    texts += [texts[8]] * 5 + [" ".join(f"w{k}" for k in range(3)) + " same" * 40]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, place long").repartition(4)
    got = nd.classes(docs).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    groups = {}
    for x in got:
        groups.setdefault(x.class_id, set()).add(x.doc_id)
    assert all(k == min(v) for k, v in groups.items())
    assert Counter(map(frozenset, groups.values())) == plain_classes(texts)
    assert nd.classes(docs.limit(0)).count() == 0


def test_classes_on_one_template_equal_all_pairs(spark):
    """Texts of one template are 0.786 alike, every two of them 0.826: no pivot links those."""
    r = random.Random(17)
    template, texts = some_words(r, 180), []
    for _ in range(60):
        both = some_words(r, 5)
        texts += [" ".join(template + both + some_words(r, 19)) for _ in range(2)]
    r.shuffle(texts)
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, place long").repartition(4)
    groups = {}
    for x in nd.classes(docs).collect():
        groups.setdefault(x.class_id, set()).add(x.doc_id)
    assert Counter(map(frozenset, groups.values())) == plain_classes(texts)


def test_class_query_equals_all_pairs(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    groups = {}
    for x in QUERIES["op4_near_duplicates"](spark, SF).collect():
        groups.setdefault(x.class_id, set()).add(x.doc_id)
    want = plain_classes([t for _, t in rows])
    assert Counter(frozenset(v) for v in groups.values()) == Counter(frozenset(rows[k][0] for k in c) for c in want)


def test_chain_is_the_best_path():
    """Against every order-preserving set of runs, scored the same way."""
    r = random.Random(9)

    def plain(runs):
        best, slack = 0.0, passages.SEED - 1
        score = []
        for j, (b, a, n) in enumerate(runs):
            here = float(n)
            for i, (b2, a2, n2) in enumerate(runs):
                if i < j and b2 + n2 - slack <= b and a2 + n2 - slack <= a:
                    here = max(here, n + score[i] - passages.GAP_COST * (a + b - a2 - n2 - b2 - n2))
            score.append(here)
            best = max(best, here)
        return best

    for _ in range(200):
        runs = sorted({(r.randint(0, 30), r.randint(0, 30)) for _ in range(r.randint(1, 6))})
        runs = [(b, a, r.randint(8, 12)) for b, a in runs]
        top = passages.chained(runs)[0]
        value = sum(n for _, _, n in top) - sum(passages.GAP_COST * (b2 + a2 - b - a - 2 * n) for (b, a, n), (b2, a2, _) in zip(top, top[1:]))
        assert value == pytest.approx(plain(runs))


def planted(r):
    passage, other = some_words(r, 70), some_words(r, 60)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45] = "xx", "yy"
    del fuzzy[50]
    docs = [some_words(r, 40) + passage + some_words(r, 30), some_words(r, 10) + passage, some_words(r, 80), fuzzy + some_words(r, 25), some_words(r, 5) + other, other, some_words(r, 30) + other[:30]]
    return [" ".join(d) for d in docs] + [None, "", "a b"], passage, other


def test_passages(spark):
    r = random.Random(11)
    texts, passage, other = planted(r)
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    got = sorted((x.place, x.start, x.end, x.other) for x in passages.passages(docs).collect())
    assert got == [(1, 10, 80, 0), (3, 0, 69, 0), (5, 0, 60, 4)]
    table = spark.createDataFrame([(k, t, "x", 9, "y") for k, t in enumerate(texts)], "doc_id long, text string, place string, n_chars long, start string").coalesce(1)
    out = {x.doc_id: x for x in passages.deduplicated(table).collect()}
    assert passages.deduplicated(table).columns == table.columns and len(out) == len(texts)
    assert [out[k].text for k in (0, 2, 4, 6, 7, 8, 9)] == [texts[k] for k in (0, 2, 4, 6, 7, 8, 9)]
    assert out[1].text == " ".join(texts[1].split()[:10]) and out[5].text == "" and out[3].text == " ".join(texts[3].split()[69:])
    assert all(x.n_chars == len(x.text or "") for x in out.values())
    assert passages.passages(docs.limit(0)).count() == 0 and passages.deduplicated(table.limit(0)).count() == 0


def test_exact_passages_behind_less_alike_ones(spark):
    """Two texts share a long run; an earlier one has it with an edit every 15 words."""
    r = random.Random(13)
    run = some_words(r, 120)
    early = [w if k % 15 else "zz" for k, w in enumerate(run)]
    texts = [" ".join(early), " ".join(run), " ".join(some_words(r, 9) + run)]
    got = {(x.place, x.other) for x in passages.passages(spark.createDataFrame(list(enumerate(texts)), "place long, text string")).collect()}
    assert (2, 1) in got or {(1, 0), (2, 0)} <= got


def test_words_between_seeds_are_compared(spark):
    """Forms of 14 fixed and 6 free words are alike in 70 %, and in less than 80 % over any 50 words."""
    r, texts = random.Random(19), []
    for _ in range(40):
        fixed = [some_words(r, 14) for _ in range(10)]
        texts += [" ".join(w for part in fixed for w in part + some_words(r, 6)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    assert passages.passages(docs).count() == 0


@pytest.mark.parametrize("holders", [1, 40])
def test_fuzzy_passages_whose_seeds_stand_earlier(spark, holders):
    """Texts with parts of a passage, out of order, hold its seeds first; the passage is found in the later two."""
    r = random.Random(23)
    own = some_words(r, 144)
    parts = [own[k : k + 36] for k in range(0, 144, 36)][::-1]
    texts = [" ".join(w for p in parts for w in [*p, *some_words(r, 60)]) for _ in range(holders)]
    edited = [w if k % 36 else f"x{k}" for k, w in enumerate(own)]  # what is left alone stands in the parts
    texts += [" ".join(some_words(r, 80) + words + some_words(r, 80)) for words in (own, edited)]
    found = passages.passages(spark.createDataFrame(list(enumerate(texts)), "place long, text string")).collect()
    assert {(x.place, x.other) for x in found} == {(holders + 1, holders)}
    assert max(x.end - x.start for x in found) >= 100


def test_exact_passages_of_chains_that_fail(spark):
    """P and Q in a document, P, other words and Q in a later one: P is cut whatever follows it."""
    r, texts, want = random.Random(23), [], {}
    for inserted, after in [(20, 12), (25, 20), (30, 40), (35, 60)] * 12:
        p, q = some_words(r, 60), some_words(r, after)
        want[len(texts) + 1] = set(range(5, 65))
        texts += [" ".join(p + q), " ".join(some_words(r, 5) + p + some_words(r, inserted) + q)]
    for x in passages.passages(spark.createDataFrame(list(enumerate(texts)), "place long, text string")).collect():
        want[x.place] -= set(range(x.start, x.end))
    assert not any(want.values())


def test_passage_query_leaves_no_long_run_twice(spark):
    rows = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    covered = {}
    for x in QUERIES["op6_substring_dedup"](spark, SF).collect():
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    left = Counter()
    for doc, words in rows.items():
        runs = {tuple(words[k : k + 60]) for k in range(len(words) - 59) if not covered.get(doc, set()) & set(range(k, k + 60))}
        left.update(runs)
    assert not [run for run, n in left.items() if n > 1]


def test_without():
    text = "  a b  c\nd e "
    assert passages.without(text, []) == text and passages.without(text, [(1, 3)]) == "a\nd e"
    assert passages.without(text, [(0, 5)]) == "" and passages.without("aa a aa", [(1, 2)]) == "aa aa"


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255
            ok = ok or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(20000):
        letters = r.choice(["0123456789.-+ ()", "ab1.@-_ +", "01 -+.", "4242 -424 0a@."])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert pii.base_spans(text)[0] == plain_spans(text), text
    assert pii.luhn("4242424242424242") and not pii.luhn("4242424242424241")
    for text in ("1" * 10**6, "a" * 10**6 + "@", "a.b@" * 10**5, "12 " * 10**5):
        found, failed = pii.base_spans(text)
        pii.candidates(text, found, failed)


def test_patterns_find_unseen_identifiers(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(k, f"{word()} please write to{k % 1 or ''} {word()}{k}@mail.example.com about {word()}") for k in range(12)]
    rows = [(k, t.replace("write to ", "write to ")) for k, t in rows]
    rows += [(50, f"{word()} please write to user9012@localhost about {word()}"), (51, f"{word()} chapter part 90125512 and {word()}"), (52, None), (53, ""), (54, "call +1 (504) 555-2652 now"), (54, "call +1 (504) 555-2652 now")]
    docs = spark.createDataFrame([(*x, "c", "d") for x in rows], "doc_id long, text string, spans string, place string")
    found = pii.found_in(docs).collect()
    assert len(found) == len(rows)
    more = {x.doc_id: [tuple(s) for s in x.more] for x in found if x.more}
    text = rows[12][1]
    at = text.index("user9012")
    assert more == {50: [(at, 0, at + len("user9012@localhost"))]}
    out = {x.doc_id: x.text for x in pii.redacted(docs).collect()}
    assert out[50] == text.replace("user9012@localhost", "<email>") and out[54] == "call <phone> now"
    assert out[51] == rows[13][1] and out[52] is None and out[53] == ""
    assert pii.found_in(docs.limit(0)).count() == 0 and pii.redacted(docs.limit(0)).count() == 0


def test_found_identifiers_find_further_ones(spark):
    """Values named by a trusted pattern are marked elsewhere, and make a pattern without seeds trusted."""
    r = random.Random(29)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    texts = [f"{word()} please write to {word()}{k}@mail.example.com about {word()}" for k in range(200)]
    texts += [f"{word()} please write to user{k}@localhost about {word()}" for k in range(20)]
    owned = range(len(texts), len(texts) + 21)
    texts += [f"{word()} the inbox owner user{k}@localhost {word()}" for k in [*range(20), 777]]
    texts += [f"{word()} {word()} user7@localhost {word()}", f"{word()} chapter part 90125512 and {word()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {x.doc_id: [texts[x.doc_id][s.start : s.end] for s in x.more] for x in pii.found_in(docs).collect() if x.more}
    want = {200 + k: [f"user{k}@localhost"] for k in range(20)} | {d: [texts[d].split()[4]] for d in owned} | {owned[-1] + 1: ["user7@localhost"]}
    assert more == want


def test_pii_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from hashlib import sha256

    for x in QUERIES["op3_pii"](spark, SF).collect():
        spans = plain_spans(texts[x.doc_id])
        listed = ",".join(f"{pii.KINDS[rank]}:{a}:{b}" for a, rank, b in spans)
        assert x.base_sha256 == sha256(listed.encode()).hexdigest()
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert set(listed.split(",")) <= set(x.spans.split(","))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    from pressmill.session import written

    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == columns
            docs = written(docs, f"test-{name}")
            after.append({r.doc_id: r.text for r in docs.collect()})
    good, unique, cut, clean = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert good.items() <= before.items() and sum(labels.get(d) == 1 for d in before.keys() - good.keys()) <= 2
    kept = sorted(good)
    for group in plain_classes([good[d] for d in kept]):
        assert sum(kept[k] in unique for k in group) == 1
    assert cut.keys() == unique.keys() == clean.keys()
    assert not any(plain_spans(t) for t in clean.values())
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length) for r in rows)
    assert len(key(whole)) == len(key(packed))


def test_a_passage_beside_a_line_of_many_texts(spark):
    """Two late texts go on alike after a line that forty others have, and share no seed beyond it."""
    r = random.Random(5)
    line = some_words(r, 44)

    def shared(texts):
        (x, at), (y, _) = (passages.seeds_of(passages.PlainWords().array(t)) for t in texts)
        return [(k, k + (passages.LONG_SEED if v & np.uint64(1) else passages.SEED)) for v, k in zip(x, at.tolist()) if v in y]

    for _ in range(1000):
        more = some_words(r, 10)
        late = [some_words(r, 40) + line + more + some_words(r, 40) for _ in range(2)]
        if all(40 <= start and end <= 84 for start, end in shared(late)):
            break
    else:
        raise AssertionError("no such texts")
    texts = [" ".join(t) for t in [*(some_words(r, 30) + line + some_words(r, 30) for _ in range(40)), *late]]
    found = passages.passages(spark.createDataFrame(list(enumerate(texts)), "place long, text string")).collect()
    assert [(x.place, x.start, x.end, x.other, x.other_start, x.other_end) for x in found] == [(41, 40, 94, 40, 40, 94)]


def test_no_pair_of_texts_with_a_passage_is_left_out(spark):
    """What ``promising`` lets through holds all that comes out when every two texts with a seed in common are aligned."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(9))
    lines = [[word() for _ in range(n)] for n in (22, 30, 45, 80)]

    def edited(words):
        out = []
        for w in words:
            kind = rng.random()
            out += [word()] if kind < 0.03 else [w, word()] if kind < 0.05 else [] if kind < 0.06 else [w]
        return out

    texts = []
    for _ in range(40):
        text = [word() for _ in range(rng.randrange(40))]
        for line in rng.sample(lines, 2):
            cut = rng.randrange(len(line) // 2)
            text += edited(line[cut:]) if rng.random() < 0.7 else line
            text += [word() for _ in range(rng.choice([0, 3, 30]))]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    seeded = passages.seeds(docs)
    a = seeded.toDF("seed", "a", "first_at")
    whole = passages.passages_of(seeded.join(a, "seed").where("a < place").select("seed", "place", "at", "a", "first_at"), docs)
    expected = {(x.place, x.other) for x in whole.collect()}
    by_place = seeded.groupBy("place").agg(F.collect_list(F.struct("seed", "at", F.lit(True).alias("open"))).alias("seeds"))
    rows = passages.surroundings(docs, by_place, "open").toArrow()
    got, met, of_row = set(), set(), rows["seed"].to_pylist()
    for seed in {*of_row}:
        own = rows.take([k for k, s in enumerate(of_row) if s == seed])
        place, other = passages.promising(seed, own, own)
        got |= {*zip(place.tolist(), other.tolist())}
        places = own["place"].to_pylist()
        met |= {(b, a) for a in places for b in places if a < b}
    assert len(expected) > 50 and expected <= got < met
