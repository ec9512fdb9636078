import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_help import DATA, shingle_set
from pyspark.sql import functions as F

from granary.llm import decontaminate as D
from granary.llm import lines, neardup, passages
from granary.llm.common import Scratch
from granary.llm.links import components
from granary.llm.registry import op2_line_dedup, op7_minhash_near_dedup, op8_substring_dedup, op9_benchmark_decontamination


def classes(sets):
    """Smallest reachable id by linking every two sets of similarity 0.75 or more."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in having[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in sets}


def rows_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("sf", [DATA, DATA.replace("0.001", "0.01")])
def test_near_duplicates_against_brute_force(spark, sf):
    sets = {i: shingle_set(t) for i, t in rows_of(spark, sf).items()}
    want = classes(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op7_minhash_near_dedup(spark, sf).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_large_group_of_edited_copies(spark):
    """Copies of one text with edits are closer to it than to each other."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(1000, " ".join(words))]
    for k in range(400):
        copy = list(words)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(150)] = f"e{k}x{rng.random()}"
        rows.append((k if k < 1000 else k + 1, " ".join(copy)))
    rows += [(2000 + k, rows[0][1]) for k in range(300)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes({i: shingle_set(t) for i, t in rows})
    assert sum(got[i] == want[i] for i in got) >= 0.995 * len(got)
    assert len({got[2000 + k] for k in range(300)}) == 1


@pytest.mark.parametrize("shared", [2, 3, 5])
def test_pairs_under_a_hot_template(spark, shared):
    """All rows hold a template that alone makes no link; two and two share some words besides."""
    rng = random.Random(31)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = own(75), []
    for k in range(150):
        both = own(shared)
        rows += [(2 * k + j, " ".join([*template, *both, *own(14 - shared)])) for j in range(2)]
    rows += [(300 + k, " ".join([*template, *own(14)])) for k in range(900)]
    sets = [shingle_set(t) for _, t in rows]
    assert all(100 * len(x & y) >= 75 * len(x | y) for x, y in zip(sets[:300:2], sets[1:300:2], strict=True))
    assert 100 * len(sets[0] & sets[-1]) < 75 * len(sets[0] | sets[-1])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - i % 2) if i < 300 else c == i for i, c in got.items())
    found = sum(got[2 * k + 1] == 2 * k for k in range(150))
    print(f"{found} of 150 pairs that share {shared} words besides")
    assert found >= {2: 135, 3: 145, 5: 150}[shared]


def test_crowded_regions_lose_no_link(spark):
    """Near the threshold under a hot template, where neighbours in sorted orders do not find all."""
    rng = random.Random(33)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = own(75), []
    for k in range(200):
        both = own(2)
        rows += [(2 * k + j, " ".join([*template, *both, *own(12)])) for j in range(2)]
    rows += [(400 + k, " ".join([*template, *own(14)])) for k in range(800)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < 400 else i for i in got}


def test_shared_parts_of_differences():
    """Any two linked sets, not both linked with a third, share a value in the first parts of their differences from it."""
    rng = np.random.default_rng(34)
    linked = 0
    for _ in range(3000):
        central = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        base = rng.choice(central, max(1, int(len(central) * rng.uniform(0.4, 1))), replace=False)
        base = np.concatenate([base, rng.integers(0, 2**63, rng.integers(0, 25), dtype=np.uint64)])
        x, y = (np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 5), dtype=np.uint64)])) for _ in range(2))
        if not len(x) or not len(y):
            continue
        link = lambda p, q: 100 * len(np.intersect1d(p, q)) >= 75 * len(np.union1d(p, q))
        far = [not link(p, central) for p in (x, y)]
        diffs = [neardup.difference(p, central) for p in (x, y)]
        assert far == [7 * len(d) > len(p) + len(central) for p, d in zip((x, y), diffs, strict=True)]
        if link(x, y) and any(far):
            linked += 1
            first = [set(d[: len(d) - neardup.least_shared(len(p), len(d), len(central), f) + 1].tolist()) for p, d, f in zip((x, y), diffs, far, strict=True)]
            assert first[0] & first[1]
    assert linked > 300


def test_second_template_under_a_hot_one(spark):
    """What many rows share besides the central row makes no candidates of them; linked rows remain ones."""
    rng = random.Random(35)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, second, rows = own(100), own(20), []
    for k in range(300):
        rest = own(60)
        rows += [(2 * k + j + 1, " ".join([*template[:40], *second, *rest[:-1], *(own(1) if k < 10 else own(30))])) for j in range(2)]
    scratch = Scratch(spark)
    texts = scratch.table(spark.createDataFrame([(0, " ".join(template)), *rows], "node long, text string"), "texts")
    open_rows = spark.createDataFrame([(i, i, 0, 0) for i, _ in rows], "node long, c long, hub long, c_hub long")
    got = {(r.a, r.b) for r in neardup._rest_pairs(open_rows, texts, scratch).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    linked = {(2 * k + 1, 2 * k + 2) for k in range(300) if 100 * len(sets[2 * k + 1] & sets[2 * k + 2]) >= 75 * len(sets[2 * k + 1] | sets[2 * k + 2])}
    assert linked >= {(2 * k + 1, 2 * k + 2) for k in range(10)}
    assert linked <= got and len(got) <= 10 * len(rows)


def test_truncated_copies_in_a_crowd(spark):
    """Beginnings of one text, of many lengths: those of a similar length are linked, the shortest only in a chain."""
    rng = random.Random(32)
    words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    rows = [(k, " ".join(words[: 60 + k])) for k in range(0, 340, 3)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes({i: shingle_set(t) for i, t in rows})


def test_near_duplicates_odd_rows(spark, docs, no_docs, docs_rows):
    got = sorted(map(tuple, neardup.near_duplicates(spark, docs).collect()), key=str)
    want = []
    first = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4, 11: 4}
    for i, t, _ in docs_rows:
        c = None if i is None else first.get(i, i)
        want.append((i, len(shingle_set(t)), c, c == i))
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(spark, no_docs).count() == 0


def test_hot_partitions_share_a_region(spark):
    """Rows at partition borders are compared too."""
    rows = [(k, " ".join(f"w{j}" for j in range(40 + k % 7))) for k in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == classes({i: shingle_set(t) for i, t in rows})


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (None, 1), (8, 9), (9, 10), (10, 11), (11, 12), (12, 8)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 8 for k in range(8, 13)}}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# Lines


def documents_of(texts, own):
    """How many documents these texts are that share a template: those whose other lines are similar count once. own(text): the lines of the template."""
    rest = {}
    for t in texts:
        lines_ = [x.split() for x in (t or "").split("\n") if x.split()]
        gone = own(t)
        rest[t] = frozenset(tuple(w[k : k + 5]) for w in lines_ if tuple(w) not in gone for k in range(max(1, len(w) - 4)))
    return len(set(classes_of_half(rest).values()))


def classes_of_half(sets):
    """As classes(), for similarity one half; empty sets are one class."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having, empty = defaultdict(list), [i for i in sets if not sets[i]]
    for i in empty:
        root[i] = empty[0]
    for i in sets:
        shared = Counter(j for s in sets[i] for j in having[s])
        for j, n in shared.items():
            if 2 * n >= len(sets[i]) + len(sets[j]) - n:
                root[find(i)] = find(j)
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in sets}


def dropped(rows, min_docs=5, depth=3, constant=0.5, short=3, short_share=0.001):
    """The templates by the definition, one line at a time."""
    mask = lambda w: "<*>" if any("0" <= c <= "9" for c in w) else w
    found = []
    for d, (_, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            if raw := tuple(x.decode(errors="replace") for x in line.encode().split()):
                w = tuple(map(mask, raw))
                found.append((d, n, raw, w, (len(w), *w[:depth])))
    texts = len({rows[d][1] for d, *_ in found})
    leaf, having = defaultdict(set), defaultdict(set)
    for d, _, _, w, key in found:
        leaf[key].add(rows[d][1])
        having[w].add(rows[d][1])
    found = [f for f in found if len(leaf[f[4]]) >= min_docs]
    cells = Counter((key, k, x) for w, key in {(f[3], f[4]) for f in found} for k, x in enumerate(w[depth:]) for _ in having[w])
    by = defaultdict(list)
    for f in found:
        key, w = f[4], f[3]
        pattern = [*w[:depth], *(x if cells[key, k, x] >= min_docs else None for k, x in enumerate(w[depth:]))]
        some = any(x is not None for x in pattern[depth:])
        by[("t", key, tuple(pattern)) if some and sum(x is not None for x in pattern) >= constant * len(w) else ("l", w)].append(f)
    gone = defaultdict(set)
    for fs in by.values():
        in_text = defaultdict(set)
        for f in fs:
            in_text[rows[f[0]][1]].add(f[2])
        few = len(in_text) < max(min_docs, short_share * texts if len(fs[0][3]) < short else 0)
        if not few and documents_of(list(in_text), in_text.__getitem__) >= min_docs:
            for f in fs:
                gone[f[0]].add(f[1])
    return gone


def check_lines(rows, got):
    gone = dropped(rows)
    want = []
    for d, (i, text) in enumerate(rows):
        kept = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone[d])
        want.append((i, 0 if text is None else text.count("\n") + 1, len(gone[d]), len(kept)))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.n_chars) for r in got), key=str) == sorted(want, key=str)
    return gone


def test_lines_against_brute_force(spark):
    sf = DATA.replace("0.001", "0.01")
    gone = check_lines(list(rows_of(spark, sf).items()), op2_line_dedup(spark, sf).collect())
    assert sum(map(len, gone.values())) > 100


def test_templates_generalise_variable_fields(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(k, f"{name()} {name()} {name()} own line\nlogged in as user {name()} on host n{k}\n{name()} {name()} {name()} {name()} more") for k in range(30)]
    rows += [(100 + k, "one text that is copied\nwith two lines in it\nand a third one here") for k in range(30)]
    got = lines.clean_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("logged in" not in r.text and r.text.count("\n") == 1 for r in got if r.doc_id < 100)
    assert all(r.text.count("\n") == 2 for r in got if r.doc_id >= 100)
    check_lines(rows, lines.line_report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_copies_do_not_keep_a_recurring_line(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.choice('abcdefgh')}{''.join(rng.choices('abcdefgh', k=8))}" for _ in range(12))
    notice = "all rights are reserved here"
    rows = [(k, f"{text()}\n{notice}") for k in range(20)]
    copied = f"{text()}\n{notice}"
    rows += [(100 + k, copied) for k in range(60)]
    got = lines.clean_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and all(notice not in r.text and "\n" not in r.text for r in got)


def own_words(rng, n):
    return " ".join("w" + "".join(rng.choices("abcdefgh", k=9)) for _ in range(n))


def cleaned(spark, rows):
    return {r.doc_id: r.text for r in lines.clean_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize(("own", "first"), [(5, True), (5, False), (200, True)])
def test_short_documents_lose_their_license(spark, own, first):
    rng = random.Random(21)
    notice = own_words(rng, 24)
    texts = {k: own_words(rng, own) for k in range(60)}
    got = cleaned(spark, [(k, f"{notice}\n{t}" if first else f"{t}\n{notice}") for k, t in texts.items()])
    assert got == texts


def test_edited_copies_keep_their_lines_and_lose_the_notice(spark):
    """A notice in different documents and in a large group of edited copies; the copies' own lines are no boilerplate."""
    rng = random.Random(22)
    notice = "all rights are reserved in this place"
    base = [own_words(rng, 12).split() for _ in range(10)]
    rows = [(k, f"{own_words(rng, 40)}\n{notice}") for k in range(100)]
    for k in range(600):
        copy = [list(x) for x in base]
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(10)][rng.randrange(12)] = own_words(rng, 1)
        rows.append((1000 + k, "\n".join([*map(" ".join, copy), notice])))
    got = cleaned(spark, rows)
    assert all(got[i] == t.removesuffix("\n" + notice) for i, t in rows)


def test_lines_of_many_copied_documents_go(spark):
    """Each of 100 documents stands there in six edited copies: copies count as one, not as none."""
    rng = random.Random(23)
    notice, rows = own_words(rng, 9), []
    for k in range(100):
        text = own_words(rng, 60).split()
        for j in range(6):
            text[rng.randrange(60)] = own_words(rng, 1)
            rows.append((6 * k + j, " ".join(text) + "\n" + notice))
    got = cleaned(spark, rows)
    assert all(got[i] == t.removesuffix("\n" + notice) for i, t in rows)


def test_short_lines_need_a_share_of_the_texts(spark):
    rng = random.Random(24)
    rows = [(k, f"{own_words(rng, 20)}\nRead more\n{own_words(rng, 20)}" + ("\nEnd" if k < 4 else "")) for k in range(30)]
    got = cleaned(spark, rows)
    assert all("Read more" not in t for t in got.values()) and all("End" in got[k] for k in range(4))


def test_clashing_columns_stay(spark, docs):
    out = lines.clean_lines(spark, docs)
    assert out.columns == [*docs.columns, "__lines"] and out.where("numbers != 'x' OR key != 'x'").count() == 0


def test_lines_odd_rows(spark, docs, no_docs, docs_rows):
    check_lines([(i, t) for i, t, _ in docs_rows], lines.line_report(spark, docs).collect())
    assert lines.line_report(spark, no_docs).count() == 0
    out = lines.clean_lines(spark, docs.drop("numbers"))
    assert out.count() == docs.count() and out.where("lang IS NULL").count() == 1


# Passages


def exact_repeats(texts, width=50):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            where[tuple(w[k : k + width])].add(i)
    return {i: c for i, w in words.items() if (c := {p for k in range(len(w) - width + 1) if len(where[tuple(w[k : k + width])]) > 1 for p in range(k, k + width)})}


def test_passages_cover_exact_repeats(spark):
    sf = DATA.replace("0.001", "0.01")
    want = exact_repeats(rows_of(spark, sf))
    got = {r.doc_id: {p for s in r.passages for p in range(s.first_word, s.first_word + s.n_words)} for r in op8_substring_dedup(spark, sf).collect()}
    assert set(want) <= set(got)
    assert sum(len(c & got[i]) for i, c in want.items()) >= 0.99 * sum(map(len, want.values()))
    assert len(set(got) - set(want)) <= 0.05 * len(got)


def test_passages_inside_other_texts(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, edited = text(60), None
    edited = [*shared[:30], "changed", *shared[31:]]
    rows = [(k, " ".join([*text(80), *shared, *text(70)])) for k in range(40)] + [(50, " ".join([*text(40), *edited, *text(40)]))]
    rows += [(60 + k, " ".join(text(200))) for k in range(20)] + [(90, " ".join(text(30)))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) >= set(range(40)) and not set(got) & {60 + k for k in range(20)} and 90 not in got
    assert all(got[k].class_id == 0 and any(s.first_word <= 80 and s.first_word + s.n_words >= 140 for s in got[k].passages) for k in range(40))


def shingled(rng, words, edits):
    """Shingles of two texts that share these words but for the edited places, between words of their own."""
    own = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    edited = words.copy()
    edited[edits] = own(len(edits))
    return [passages.shingles(np.concatenate([own(30), w, own(20)])) for w in (words, edited)]


def test_stretches_join_over_edits_anywhere():
    """Every passage that begins and ends with a shared shingle, has the length and the similarity is found."""
    rng = np.random.default_rng(4)
    places = [(n, [p]) for n in (54, 60, 70) for p in range(n)] + [(n, sorted(rng.choice(n, k, replace=False))) for n, k in ((80, 2), (120, 3), (160, 4)) for _ in range(300)]
    found = 0
    for n, edits in places:
        x, y = shingled(rng, rng.integers(0, 1 << 62, n).astype(np.uint64), edits)
        shared = np.flatnonzero(np.isin(x, y))
        want = set()
        for a in shared:
            for b in shared[shared >= a + 45]:
                both = int(((shared >= a) & (shared <= b)).sum())
                if both >= 0.75 * (2 * (b - a + 1) - both):
                    want |= set(range(a, b + 1))
        got = passages.stretches(x, y)
        assert {k for a, b, _, _ in got for k in range(a, b + 1)} == want and all(a == c and b == d for a, b, c, d in got)
        found += bool(want)
    assert found > 0.9 * len(places)


def test_edited_passage_inside_other_texts(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    rows = [(k, " ".join([*text(80), *shared, *text(70)])) for k in range(40)] + [(50, " ".join([*text(40), *shared[:30], "changed", *shared[31:], *text(40)]))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].class_id == 0 and any(s.first_word <= 40 and s.first_word + s.n_words >= 100 for s in got[50].passages)


def test_passages_around_a_frequent_line(spark):
    """Documents with a frequent line in other surroundings lie between two that share a passage with it."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = text(32)
    rows = [(k, [*text(60), *line, *text(60)]) for k in range(1000)]
    for k in range(20):
        before, behind = text(14), text(14)
        for i in (k, 500 + k):
            rows[i] = (i, [*text(50), *before, *line, *behind, *text(50)])
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r.doc_id: r for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= {*range(20), *range(500, 520)}
    assert sum(k in got and 500 + k in got and got[500 + k].class_id == k for k in range(20)) >= 19


def test_passages_between_decoys_of_a_frequent_line(spark):
    """Many documents share the line and what is on one side of it with a pair, so no order brings the pair together."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, rows = text(30), []
    for _ in range(12):
        before, behind = text(10), text(10)
        pair = [[*text(50), *before, *line, *behind, *text(50)] for _ in range(2)]
        rows += pair + [[*text(50), *before, *line, *text(60)] for _ in range(30)] + [[*text(60), *line, *behind, *text(50)] for _ in range(30)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[k], " ".join(w)) for k, w in enumerate(rows)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [sorted((rows[k][0], rows[k + 1][0])) for k in range(0, len(rows), 62)]
    found = sum(a in got and b in got and got[a].class_id == got[b].class_id == a for a, b in pairs)
    assert found == len(pairs) and set(got) == {i for p in pairs for i in p}
    assert all(any(s.first_word <= 50 and s.first_word + s.n_words >= 100 for s in got[i].passages) for p in pairs for i in p)


def test_passages_in_another_order(spark):
    """Two passages around one line, in one document the other way round: no window is paired with the wrong one only."""
    rng = random.Random(10)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, other = text(60), text(60)
    rows = [(1, " ".join([*text(30), *one, *text(70), *other, *text(30)])), (2, " ".join([*text(30), *other, *text(70), *one, *text(30)]))]
    got = covered(passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(range(30, 90)) | set(range(160, 220)) <= got[1] and set(range(30, 90)) | set(range(160, 220)) <= got[2]


def covered(rows):
    return {r.doc_id: {p for s in r.passages for p in range(s.first_word, s.first_word + s.n_words)} for r in rows}


def test_every_occurrence_in_one_document(spark):
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    one = [w for _ in range(6) for w in [*text(50), *shared]]
    rows = [(1, " ".join(one)), (2, " ".join([*text(70), *shared, *text(30)])), (3, " ".join(text(300)))]
    got = covered(passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(got) == {1, 2} and set(range(70, 130)) <= got[2]
    assert all(set(range(50 + 110 * k, 110 + 110 * k)) <= got[1] for k in range(6))


def test_recall_of_edited_passages(spark):
    """Planted passages of 100 words, one to six of them changed, left out or put in, in texts of their own."""
    rng = random.Random(16)
    text = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    rows, linked, wanted = [], [], {}
    for k in range(300):
        shared = text(100)
        other = list(shared)
        for _ in range(rng.randrange(1, 7)):
            at, kind = rng.randrange(1, len(other) - 1), rng.random()
            other[at : at + 1] = text(1) if kind < 0.7 else [] if kind < 0.85 else [other[at], *text(1)]
        for i, part in ((2 * k, shared), (2 * k + 1, other)):
            before = rng.randrange(20, 200)
            rows.append((i, " ".join([*text(before), *part, *text(rng.randrange(20, 200))])))
            wanted[i] = set(range(before + 1, before + len(part) - 1))
        p, q = shingle_set(" ".join(shared)), shingle_set(" ".join(other))
        if 100 * len(p & q) >= 75 * len(p | q):
            linked.append(k)
    found = passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got, classes_ = covered(found), {r.doc_id: r.class_id for r in found}
    assert len(linked) > 100
    recall = sum(classes_.get(2 * k + 1) == 2 * k for k in linked) / len(linked)
    share = sum(len(got.get(i, set()) & wanted[i]) for k in linked for i in (2 * k, 2 * k + 1)) / sum(len(wanted[i]) for k in linked for i in (2 * k, 2 * k + 1))
    print(f"recall {recall:.3f}, words covered {share:.3f} of {len(linked)} pairs")
    assert recall >= 0.95 and share >= 0.9
    assert all(c in (i, i - 1) for i, c in classes_.items())


def near_windows(texts, percent):
    """Documents with a window of 50 words that is similar, by sets of shingles, to a window of another one: by trying all that share a shingle."""
    n = 46
    runs = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, t in texts.items() if len(w := (t or "").encode().lower().split()) >= 50}
    where = defaultdict(list)
    for i, s in runs.items():
        for k, x in enumerate(s):
            where[x].append((i, k))
    tried, out = set(), set()
    for i, s in runs.items():
        for k, x in enumerate(s):
            for j, m in where[x]:
                if j <= i or (i in out and j in out):
                    continue
                for a in range(max(0, k - n + 1), min(k, len(s) - n) + 1, 15):
                    b = a + m - k
                    if 0 <= b <= len(runs[j]) - n and (i, a, j, b) not in tried:
                        tried.add((i, a, j, b))
                        p, q = set(s[a : a + n]), set(runs[j][b : b + n])
                        if 100 * len(p & q) >= percent * len(p | q):
                            out |= {i, j}
    return out


def test_passages_against_all_windows(spark):
    texts = rows_of(spark, DATA)
    got = {r.doc_id for r in op8_substring_dedup(spark, DATA).collect()}
    want = near_windows(texts, 75)
    assert len(want & got) >= 0.9 * len(want) and want
    # A passage ends with a shared shingle, so the windows tried, at every 15th place, may miss its best part.
    assert got - want <= near_windows({i: texts[i] for i in texts if i in got}, 60)


def test_periodic_texts(spark):
    rows = [(1, "a " * 30_000), (2, "a " * 20_000), (3, "b c " * 5000), (4, " ".join(f"w{k % 7}" for k in range(20_000))), (5, " ".join(f"w{k % 7}" for k in range(9000)))]
    got = {r.doc_id: (r.class_id, r.n_repeated_words) for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: 1, 2: 1, 4: 4, 5: 4}
    assert got[2][1] == 20_000 <= got[1][1] and got[5][1] == 9000 <= got[4][1]


def test_passages_odd_rows(spark, docs, no_docs):
    got = {r.doc_id: (r.class_id, r.n_repeated_words) for r in passages.repeated_passages(spark, docs).collect()}
    assert set(got) == {1, 2, 3, 4, 11} and got[2] == (1, 88) and got[11] == (4, 66)
    assert passages.repeated_passages(spark, no_docs).count() == 0


def test_compact_windows():
    h = np.random.default_rng(0).integers(0, 100, 200).astype(np.uint64)
    found = passages.compact_windows(h, 20)
    for a in range(181):
        for b in (a + 19, min(199, a + 60)):
            c = a + int(h[a : b + 1].argmin())
            assert any(lo <= a and b <= hi and mid == c for lo, mid, hi in found)


# Leaks


def brute_leaks(texts, items):
    index = D.Index(items)
    out = set()
    for d, text in texts:
        raw = D.raw_words(text)
        clean = lambda ws: [w for x in ws if (w := x.strip(D.PUNCTUATION))]
        for i, parts in zip(index.ids, index.parts, strict=True):
            for k in range(0, max(1, len(raw)), index.passage // 2):
                if raw and all(D.overlap(p, clean(raw[k : k + index.passage])) >= D.OVERLAP for p in parts):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [50_000, 7])
def test_leaks_against_brute_force(spark, shard):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark, docs, items, shard_items=shard).collect()}
    assert shard != 50_000 or got == {(r.doc_id, r.item_id) for r in op9_benchmark_decontamination(spark, DATA).collect()}
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want
    left = D.drop_leaks(spark, docs, items, shard_items=shard)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_shards_do_not_change_hits(spark):
    """Scores, passages and overlaps row by row, with repeated items among them."""
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = items.union(items.limit(5))
    rounded = lambda size: sorted((r.doc_id, r.item_id, round(r.score, 9), r.first_word, r.question_overlap, r.answer_overlap) for r in D.find_leaks(spark, docs, items, shard_items=size).collect())
    assert rounded(50_000) == rounded(7) == rounded(1)


def leaks_of_windows(texts, items):
    """With own words, parts and windows: (doc, item) where some stretch of a text as long as the longest item has both parts."""
    strip = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = lambda t: [w for x in t.encode().lower().split() if (w := x.strip(strip.encode()))]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    parts = {}
    for i, t in items:
        cut = [x for x in (t or "").split("\n") if x.strip()]
        if len(cut) < 2:
            import re

            cut = re.split(r"(?<=[.!?])\s+", (t or "").strip())
        parts[i] = [words(" ".join(cut[:-1])), words(cut[-1])] if len(cut) > 1 else [words(t or "")]
    longest = max(sum(map(len, p)) for p in parts.values())
    out = set()
    for d, t in texts:
        w = words(t or "")
        for i, ps in parts.items():
            for k in range(0, max(1, len(w) - longest + 1), max(1, longest // 4)):
                window = w[k : k + longest + longest // 4]
                if all(p for p in ps) and all(len(grams(p, min(5, len(p))) & grams(window, min(5, len(p)))) >= 0.75 * len(grams(p, min(5, len(p)))) for p in ps):
                    out.add((d, i))
    return out


def test_leaks_against_own_windows(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id) for r in op9_benchmark_decontamination(spark, DATA).collect()}
    assert got >= leaks_of_windows(docs, items) and got


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(2)
    vocabulary = [f"t{k}" for k in range(60)]
    index = D.Index([(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 12)))) for k in range(200)])
    for _ in range(200):
        terms = {index.terms[w] for w in rng.sample(vocabulary, rng.randrange(1, 25)) if w in index.terms}
        scores = Counter()
        for t in terms:
            for i, x in zip(*index.postings[t], strict=True):
                scores[i] += x
        want = {i for i, s in scores.items() if s >= D.THRESHOLD}
        assert {i for i, _ in index.retrieve(terms)} == want


def test_leaks_odd_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "few words here"), (None, "the0 quick1 brown2 fox3 jumps4 over5 the6 lazy7")], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark, docs, items).collect()}
    assert got == {(8, 3), (9, 3), (1, None), (2, None), (None, None)}
    assert D.find_leaks(spark, no_docs, items).count() == 0 and D.find_leaks(spark, docs, items.where("false")).count() == 0
    assert D.drop_leaks(spark, docs, items).count() == docs.count() - 5


def test_lines_of_texts_parsed_together_are_those_of_each_alone(spark):
    odd = [None, "", "\n \n", "one", "a b\nc", "a b c d e f g\na b c d e f g\n", "x 1 y 2 z\n\nx 3 y 4 z\nw", "same line here\nsame line here"]
    texts = odd + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(200).collect()] + odd
    together = lines.parse(texts, lines.TokenHashes())
    alone = [lines.parse([t], lines.TokenHashes()) for t in texts]
    assert together[0].tolist() == [k for k, a in enumerate(alone) for _ in a[0]]
    for k in range(1, 7):
        assert np.array_equal(together[k], np.concatenate([a[k] for a in alone]))


def test_windows_are_gone_when_shingles_are_dealt_out(spark, monkeypatch):
    held, plain = {}, Scratch.table

    def table(self, df, name):
        held[name] = set(self.paths)
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "table", table)
    assert op8_substring_dedup(spark, DATA).count()
    assert "inside" in held["frequent"]
    assert not {"windows", "many"} & (held["further"] | held["frequent"])
    assert "inside" not in held["rare"]
