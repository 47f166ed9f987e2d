"""Each operator against a brute-force version, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, documents, prose, rows, texts
from pyspark.sql import functions as F

from tallyspark.llm import language, mixing, neighbours, packing, pii, quality, simhash, substring, topk, toxicity
from tallyspark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- op1 ---------------------------------------------------------------------------


def brute_repeats(docs):
    words = {i: WORD.findall(t or "") for i, t in docs}
    low = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            low.setdefault(tuple(words[i][p : p + 50]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - 49):
            if low[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot_runs", [4_000, 0])
def test_substring_dedup(spark, hot_runs):
    got = substring.remove_repeats(documents(spark), hot_runs=hot_runs).collect()
    expected = brute_repeats([(i, t) for i, t, *_ in texts() if i != 12] + [(12, "loop " * 60)])
    expected[12] = (30_000, 0, hashlib.sha256(("loop " * 30_000).strip().encode()).hexdigest())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert expected[3][1] == 70 and expected[4][1] == 70 and expected[9][1] == 200 and expected[10][1] == 199


def test_substring_dedup_repeated_and_null_ids(spark):
    t = prose(1, 60)
    got = rows(substring.remove_repeats(documents(spark, [(1, t, None, None), (1, t, None, None), (None, t, None, None)])).drop("kept"), "doc_id")
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(1, 0), (1, 0), (None, 60)]


def test_window_hashes_are_polynomials_modulo_the_prime():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, substring.PRIME, 80, np.uint64)
    for base in (substring.BASE, substring.PRIME - 1):
        for width in (1, 2, 7, 8, 50, 80):
            plain = [sum(int(x) * pow(base, width - 1 - k, substring.PRIME) for k, x in enumerate(symbols[i : i + width])) % substring.PRIME for i in range(81 - width)]
            assert substring.polynomials(symbols, width, base).tolist() == plain
    assert len(substring.polynomials(symbols[:3], 50)) == 0


def test_texts_built_to_collide_stay_apart(spark):
    """Thue-Morse words and their complement collide for every odd base modulo 2**64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    data = [(1, "w " * 60 + word + " z" * 60, None, None), (2, "w " * 60 + other + " z" * 60, None, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(documents(spark, data)).collect()}
    assert got == brute_repeats([(i, t) for i, t, *_ in data]) and got[2][1] == 120


def equal_hash_words(seed: int = 7) -> tuple[str, str]:
    """Two printable words of 64 letters with one XXH64: one of its lanes is undone by the second half."""
    mask, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F  # fixed values: XXH64's primes
    undo = pow(p2, -1, 1 << 64)
    rng = random.Random(seed)
    letters = [chr(c) for c in range(33, 127)]

    def lane(half: int) -> int:
        v = (p1 + p2 + half * p2) & mask
        return ((v << 31 | v >> 33) & mask) * p1 & mask

    rest = "x" * 24
    while True:
        a, c, b = ("".join(rng.choice(letters) for _ in range(8)) for _ in range(3))
        number = lambda s: int.from_bytes(s.encode(), "little")
        d = (number(b) + (lane(number(a)) - lane(number(c))) * undo) & mask
        raw = d.to_bytes(8, "little")
        if all(33 <= x < 127 for x in raw):
            one, two = a + rest + b + rest, c + rest + raw.decode() + rest
            assert xxhash.xxh64_intdigest(one) == xxhash.xxh64_intdigest(two) and one != two
            return one, two


@pytest.mark.parametrize("hot_runs", [4_000, 0])
def test_words_of_one_hash_stay_apart(spark, hot_runs):
    """Windows that only hashes make equal stay, also beside windows that really repeat."""
    one, two = equal_hash_words()
    base = prose(1, 25)
    a, b = f"{base} {one} {prose(2, 40)}", f"{base} {two} {prose(2, 40)}"
    data = [(1, a, None, None), (2, b, None, None), (3, b + " end", None, None), (4, a, None, None), (5, a + " " + b, None, None), (6, prose(8, 90), None, None), (7, prose(8, 90), None, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(documents(spark, data), hot_runs=hot_runs).collect()}
    want = brute_repeats([(i, t) for i, t, *_ in data])
    assert got == want and got[2][1] == 0 and got[3][1] == 66 and got[4][1] == 66 and got[7][1] == 90


def test_many_copies_of_a_row_take_linear_time(spark):
    t, u = prose(1, 300), prose(2, 300)
    data = [(5, t, None, None)] * 3000 + [(None, t, None, None)] * 2000 + [(6, u, None, None), (7, u, None, None)]
    got = Counter((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(documents(spark, data)).collect())
    assert got == {(5, 0): 3000, (None, 300): 2000, (6, 0): 1, (7, 300): 1}


# ---- op2 ---------------------------------------------------------------------------


def water_fill(sizes):
    """Targets by giving out and resharing, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, open_, full = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {**full, **share}
        full.update({s: 3 * sizes[s] for s in over})
        open_ -= over
    return full


def test_mixing(spark):
    rng = random.Random(4)
    data = [(i, prose(i, rng.randint(1, 60)), None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(900, None, None, "c"), (901, "", None, "z"), (902, "!!! ### $$", None, "b")]
    got = mixing.mix(documents(spark, data)).collect()
    again = mixing.mix(documents(spark, data).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    target = water_fill(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 30
        if sizes[s]:
            epochs = math.floor(target[s] / sizes[s])
            assert all(r["copies"] in (epochs, epochs + 1) for r in got if r["source"] == s)


def test_draw_prefix_and_closing_equal_plain_sampling(spark):
    """Keys -ln(u)/w of the ids, sorted; documents while they fit the budget; one more by the nearest size."""
    rng = random.Random(9)
    data = [(i, prose(i, rng.randint(1, 40)) + (" ### $$ %%" if i % 3 == 0 else ""), None, rng.choice(["a", "a", "b", None])) for i in range(400)]
    data += [(None, prose(5, 7), None, "a"), (3, prose(6, 2), None, "a"), (3, prose(7, 39), None, "a"), (8, None, None, "b")]
    docs = documents(spark, data)
    keyed = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.quality_weight(F.col("text")).alias("w"), F.xxhash64(F.lit(11), "doc_id", "source").alias("h")).collect()
    sizes = Counter()
    for r in keyed:
        sizes[r["source"]] += r["size"]
    target, expected = water_fill(sizes), Counter()
    for s in sizes:
        mine = sorted((max(-math.log((((r["h"] % 2**64) >> 11) + 0.5) / 2**53) / r["w"], 1e-300), -1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in keyed if r["source"] == s)
        epochs = math.floor(target[s] / sizes[s])
        budget, at, left_out = target[s] - epochs * sizes[s], 0, []
        chosen = []
        for key, i, size in mine:
            (chosen if at + size <= budget else left_out).append((key, i, size))
            at += size
        gap = budget - sum(x[2] for x in chosen)
        close = min(((abs(size - gap), key, i, size) for key, i, size in left_out if size), default=None)
        if close and close[0] < abs(gap):
            chosen.append(close[1:])
        for _, i, size in mine:
            expected[s, i, size * epochs] += 1
        for _, i, size in chosen:
            expected[s, i, size * epochs] -= 1
            expected[s, i, size * (epochs + 1)] += 1
    got = Counter((r["source"], -1 if r["doc_id"] is None else r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    assert got == +expected


def test_key_ranges_are_even_whatever_the_weights(spark, monkeypatch):
    data = [(i, ("a" if i % 3 else "!!! ### $$$ %%%"), None, "hot") for i in range(6000)]
    plain, ranges = mixing.settle, []

    def settle(df, name):
        out = plain(df, name)
        if name == "mix-sizes":
            kept.append(out)
        if name == "mix-ranges":
            steps = out.collect()
            counts = Counter(r["step"] for r in kept[0].select("step").collect())
            rows_of = Counter()
            for r in steps:
                rows_of[r["range"]] += counts[r["t"]]
            ranges.extend(rows_of.values())
        return out

    kept: list = []
    monkeypatch.setattr(mixing, "settle", settle)
    assert mixing.mix(documents(spark, data)).count() == 6000
    assert len(ranges) == mixing.LEAST_RANGES and max(ranges) < 2 * sorted(ranges)[len(ranges) // 2]


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- op3 ---------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius=3):
    root = {i: i for i in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(points)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    data = [r for r in texts() if r[0] != 12] + [(20 + k, prose(1, 200 - k % 5), "en", "web") for k in range(10)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, data)).collect()}
    points = {i: brute_fingerprint(t) for i, t, *_ in data}
    component = brute_components(points)
    assert got == {i: (f"{points[i]:016x}", component[i]) for i in points}
    assert component[5] == component[6] == component[7] == 5 and component[9] == 1


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    import corpus_pipeline

    a, b, c, d, e = (prose(70 + k, 150) for k in range(5))
    data = [(None, a, "en", "web"), (None, b, "en", "web"), (None, b, "en", "book"), (7, c, "en", "web"), (7, d, "en", "web"), (3, c.upper(), "en", "web"), (9, e, "en", "web"), (9, e, "en", "web"), (None, e, "en", "web")]
    got = corpus_pipeline.near_dedup(spark, documents(spark, data), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", a), ("None", b), ("3", c.upper()), ("7", d), ("9", e)])
    assert got[0].__fields__ == list(corpus_pipeline.COLUMNS)


def test_tree_is_fitted_on_a_fraction_of_the_fingerprints(spark, monkeypatch):
    drawn, plain = [], simhash.VantageTree

    def tree(sample, *args, **kwargs):
        drawn.append(len(sample))
        return plain(sample, *args, **kwargs)

    monkeypatch.setattr(simhash, "VantageTree", tree)
    data = [(k, prose(k, 30), "en", "web") for k in range(400)]
    got = simhash.near_duplicates(documents(spark, data), shard=40).collect()
    component = brute_components({i: brute_fingerprint(t) for i, t, *_ in data})
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert 0 < drawn[0] <= 400 / 4


def test_vantage_tree_loses_no_link():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 300, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(3000)], np.uint64)
    points = np.unique(rng.choice(centres, 3000) ^ flips)
    tree = simhash.VantageTree(points, 100)
    shards = defaultdict(set)
    for number, at in tree.route(points):
        for i in at:
            shards[int(i)].add(number)
    assert tree.shards > 5 and len(shards) == len(points)
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert shards[int(i)] & shards[int(j)]
    label = simhash.link_shard(points)
    brute = brute_components({k: int(p) for k, p in enumerate(points)})
    assert label.tolist() == [brute[k] for k in range(len(points))]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1201))


# ---- op4 ---------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    pieces = ["a.b@c.de", "x@y", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "12.3.4.256", " ", "-", ".", "7", "00", "q", "é", "+49(0)30.11.22", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("head", ["PASSWORD=", "Passwd: ", "PWD=", "SECRET: ", "TOKEN=", "api_key=", "Api_Key: "])
def test_secrets_are_whole_in_every_spelling(head):
    weights = np.r_[np.zeros(pii.N_FEATURES), 1.0]  # accepts every candidate
    for value in ("qwertyuiop", "aBcD-_" * 500, "x" * 200_000):
        text = f"see {head}{value} there"
        _, spans = pii.find_spans(text, weights)
        assert spans == [("secret", 4, 4 + len(head) + len(value))]
        assert pii.redact(text, spans) == "see [secret] there"
    assert pii.find_spans("AKIA" + "Q" * 16, weights)[1] == [("secret", 0, 20)]


def test_personal_data(spark):
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark)).collect()}
    assert set(got) == {i for i, *_ in texts()}
    for i, t, *_ in texts():
        base = brute_spans(t or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_email"] == sum(k == "email" for k, *_ in base)
    assert got[5]["redacted"] is None
    assert got[13]["redacted"] == "mail [email] or [phone], [ip] and [card]"


def test_expectation_maximisation_finds_the_good_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.5
    vote = lambda accuracy: np.where(rng.random(4000) < accuracy, truth, ~truth).astype(int)
    votes = np.stack([vote(0.95), vote(0.9), vote(0.6)], 1)
    post, table, _ = pii.estimate_reliability(votes, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert table[0, 1, pii.YES] > table[1, 1, pii.YES] > table[2, 1, pii.YES]


def test_expectation_maximisation_never_lowers_its_likelihood():
    rng = np.random.default_rng(12)
    for share in (0.1, 0.5, 0.9):
        truth = rng.random(3000) < share
        votes = np.stack([np.where(rng.random(3000) < 0.3, pii.ABSTAIN, np.where(rng.random(3000) < a, truth, ~truth)) for a in (0.95, 0.9, 0.8, 0.7)], 1)
        post, _, trace = pii.estimate_reliability(votes, rng.integers(1, 9, 3000).astype(float))
        assert len(trace) > 3 and np.diff(trace).min() >= -1e-9 * abs(trace[-1])
        assert ((post > 0.5) == truth).mean() > 0.9


def test_written_addresses_are_whole():
    text = "x" * 300 + " (at) " + "y" * 200 + " [dot] " + "z" * 60
    assert [c[:3] for c in pii.candidates(f"to {text}, now", [])] == [("email", 3, 3 + len(text))]


def test_a_number_of_any_length_is_one_span():
    for number in (" ".join(["4321"] * 50), "(0123) 4567 8901 2345 6789 0123 4567", "1-" * 300 + "1"):
        found = pii.candidates(f"x {number} y", [])
        assert [c[:3] for c in found] == [("phone", 2, 2 + len(number))]
        assert found[0][3:] == pii._judge(f"x {number} y", "phone", 2, 2 + len(number), False)


def test_toxic_fit_is_bounded_by_bytes(spark):
    docs = documents(spark, [(i, prose(i, 20 + i % 7), None, None) for i in range(200)] + [(500, prose(1, 3000), None, None)])
    known = docs.select("doc_id", F.lit(1).alias("y"))
    size = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    drawn = [r["doc_id"] for r in toxicity.drawn_texts(docs, known, 150, 64 * 300).collect()]
    assert len(set(drawn)) == len(drawn) <= 150 and 500 not in drawn
    assert 64 * 300 - 300 <= sum(size[i] for i in drawn) <= 64 * 300
    assert len(toxicity.drawn_texts(docs, known, 150, 1 << 30).collect()) == 150


# ---- op5 ---------------------------------------------------------------------------


def test_non_negative_risk_and_its_slope():
    rng = np.random.default_rng(3)
    loss = lambda v: math.log(1 + math.exp(v))
    for shift, prior in ((0.0, 0.3), (-6.0, 0.9)):  # the second has a negative part below zero
        trusted, rows = rng.integers(0, 4, 9).astype(float), rng.integers(1, 5, 9).astype(float)
        value = rng.normal(size=9) + 2 + np.where(trusted > 0, 0, shift)
        if shift:
            rows[trusted > 0] = 0
        good, every = ([v for v, n in zip(value, count) for _ in range(int(n))] for count in (trusted, rows))
        negative = sum(map(loss, every)) / len(every) - prior * sum(map(loss, good)) / len(good)
        got, slope = quality.risk(value, trusted, rows, prior)
        assert got == pytest.approx(prior * sum(loss(-v) for v in good) / len(good) + max(0, negative)) and (negative >= 0) == (shift == 0.0)
        for k in range(9):
            moved = quality.risk(value + 1e-6 * (np.arange(9) == k), trusted, rows, prior)[0]
            if negative >= 0:
                assert (moved - got) / 1e-6 == pytest.approx(slope[k], abs=1e-4)
            elif not trusted[k]:
                assert slope[k] < 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_is_found_without_negatives(share):
    rng = np.random.default_rng(int(share * 10))
    good, other = lambda n: rng.normal(1.5, 1, (n, 6)), lambda n: rng.normal(-1.5, 1, (n, 6))
    n = 6000
    x = np.vstack([good(int(n * share)), other(n - int(n * share))])
    trusted = ((np.arange(n) < n * share) & (rng.random(n) < 0.3)).astype(float)
    prior = quality.class_prior(x, trusted, np.ones(n))
    assert prior == pytest.approx(share, abs=0.06)
    net = quality.fit(x, trusted, np.ones(n), prior)
    assert net.score(good(500)).mean() > 0.9 and net.score(other(500)).mean() < 0.1


def test_cells_count_every_row(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4)).astype(np.float32)
    table = spark.createDataFrame([([float(v) for v in r], i % 3 == 0) for i, r in enumerate(x)], "x array<float>, trusted boolean").repartition(5)
    drawn = x[:40].astype(float)
    mean, trusted, rows = quality.cells_of(table, drawn)
    apart = (((x[:, None] - drawn[None]) / (drawn.std(0) + 1e-3)) ** 2).sum(2)
    cell = apart.argmin(1)
    assert rows.tolist() == [(cell == k).sum() for k in sorted(set(cell))] and rows.sum() == 900
    assert trusted.tolist() == [(cell[::3] == k).sum() for k in sorted(set(cell))]
    assert mean == pytest.approx(np.array([x[cell == k].mean(0) for k in sorted(set(cell))]), abs=1e-5)


# ---- op6 ---------------------------------------------------------------------------


def test_language_profiles(spark):
    data = [(i, f"der schnelle braune fuchs {i} und die katze springen über den zaun", "de", None) for i in range(40)]
    data += [(100 + i, f"the quick brown fox {i} and the cat are jumping over the fence", "en", None) for i in range(40)]
    data += [(200, None, "en", None), (201, "123 456", "en", None), (202, "die katze und der hund", None, None), (203, "", None, None)]
    got = {r["doc_id"]: r for r in language.identify(documents(spark, data)).collect()}
    assert all(got[i]["lang_pred"] == "de" for i in [*range(40), 202]) and all(got[100 + i]["lang_pred"] == "en" for i in range(40))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 203))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)


def test_ngrams_count_as_plain_slices():
    for text in ("Hello, wörld a", "x", "12", "a-b c", "中文 abc"):
        plain = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{word}_"
            plain.update(word)
            plain.update(padded[i : i + 2] for i in range(len(padded) - 1))
            plain.update(padded[i : i + 3] for i in range(len(padded) - 2))
        assert sorted(Counter(language.ngrams(text).tolist()).values()) == sorted(plain.values())


def test_profiles_rank_by_count_then_code(spark):
    got = language.train_profiles(spark.createDataFrame([("x", "ab ab a"), ("x", None), (None, "zz")], "lang string, text string"), 4).collect()
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == [0, 1, 2, 3] and {r["lang"] for r in got} == {"x"}


def test_nearest_profile_by_plain_out_of_place_distance(spark):
    """Ranks of a document's most frequent n-grams against each profile's, one by one."""
    data = [(i, f"der schnelle braune fuchs {i} und die katze springen über den zaun", "de", None) for i in range(30)]
    data += [(100 + i, f"the quick brown fox {i} and the cat are jumping over the fence", "en", None) for i in range(30)]
    size, table = 60, language.train_profiles(documents(spark, data), 60)
    profiles = defaultdict(dict)
    for r in table.collect():
        profiles[r["lang"]][r["gram"]] = r["place"]
    judge = language.Profiles(table.collect(), size)
    for text in ("die katze und the fox", "zaun zaun fence", "x", "brown braune", "über " * 400):
        counts = Counter(language.ngrams(text).tolist())
        own = sorted(counts, key=lambda g: (-counts[g], g))[:size]
        apart = {lang: sum(abs(places[g] - k) if g in places else size for k, g in enumerate(own)) for lang, places in profiles.items()}
        near = {lang: 1 - d / (size * len(own)) for lang, d in apart.items()}
        best = min(sorted(apart), key=apart.get)
        assert judge.judge(text) == (best, pytest.approx(near[best] / sum(near.values()) if sum(near.values()) else 0.0))


# ---- op7 ---------------------------------------------------------------------------


@pytest.mark.parametrize("items_per_task", [50_000, 4])
def test_packing(spark, items_per_task):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    data = [*texts(), (30, prose(30, 3000), "en", "web"), (31, "<|endoftext|> </s>", "en", "web")]
    got = packing.pack_pieces(packing.tokenise(documents(spark, data)), items_per_task=items_per_task).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in data}
    found, used = defaultdict(list), defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, pieces in found.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids[i])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert all(r["length"] == 1024 for r in pieces[1:]) and len(pieces) == -(-len(ids[i]) // 1024)
    assert set(found) == set(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert least <= len(used) <= least + 2


@pytest.mark.parametrize("low,high,alike", [(520, 1000, 0), (13, 13, 0), (300, 724, 0), (600, 600, 2000), (13, 13, 2000)])
def test_packing_tasks_stay_bounded(spark, monkeypatch, low, high, alike):
    """At 100 items and 400 pieces a task on average, none writes more than half as many again, also of rows alike."""
    rng = random.Random(6)
    ids = [min(i, 4000 - alike) for i in range(4000)]
    made = [(i, 0, 0, rng.randint(low, high), i) for i in ids]
    made = [made[min(k, len(made) - max(alike, 1))] for k in range(4000)]
    pieces = spark.createDataFrame(made, packing.PIECE)
    plain, largest = packing.settle, []

    def settle(df, name):
        out = plain(df, name)
        n = df.groupBy(F.spark_partition_id()).agg(F.sum(F.size("members")).alias("n"))
        largest.append(max((r["n"] for r in n.collect()), default=0))
        return out

    monkeypatch.setattr(packing, "settle", settle)
    got = packing.pack_pieces(pieces, items_per_task=100).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in made)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024
    assert max(largest) <= 600, largest
    if low == 300:  # complements meet
        assert len(used) <= 1.1 * sum(used.values()) / 1024


def test_both_tokenizers_agree_on_every_character_of_the_fast_one():
    """Every code point that goes through the rank file, in contexts of every class, alone and doubled."""
    encoder = packing.encoder("byte_bpe_50k")
    for code in [*range(0x250), *range(0x2010, 0x2028)]:
        c = chr(code)
        assert not encoder.other.search(c)
        text = f"a{c}b 1{c}2 .{c}! {c} {c}{c}x\n{c}\n {c}'s {c}'{c} \u00e9{c}\u00e9  {c}"
        assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids, hex(code)


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    data = [(None, prose(i, 5), None, "a") for i in range(300)] + [(i, prose(i, 5), None, "b") for i in range(300)]
    taken = [r["copies"] for r in mixing.mix(documents(spark, data), weights=(1.0, 3.0)).filter("source = 'a'").collect()]
    assert len(taken) == 300 and 0 < sum(taken) < 300 and set(taken) == {0, 1}


def test_best_fit_is_exact_and_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1023) for _ in range(2000)]
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= 1.03 * sum(sizes) / 1024 + 1


# ---- op8, op9 ----------------------------------------------------------------------


def vectors(n=900, dim=24):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[100:140] = v[100]
    v[300] = 0
    data = [(i, [float(x) for x in v[i]], 1) for i in range(n)]
    data[350] = (350, None, 1)
    data[351] = (351, [None, *data[351][1][1:]], 1)
    data[352] = (352, [float("nan"), *data[352][1][1:]], 1)
    data[353] = (353, [float("inf"), *data[353][1][1:]], 1)
    return data


def test_vectors_of_any_finite_size_take_part(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[3] *= 1e200
    v[7] *= 1e-200
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in neighbours.nearest(table, k=59).orderBy("rank").filter("query_id = 0").collect()]
    unit = v / np.abs(v).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert [i for _, i in got] == sorted(range(1, 60), key=lambda i: -(unit[i] @ unit[0]))


def embeddings(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def brute_best(data, score):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in data if v is not None and None not in v and np.isfinite(v).all()]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-s, i) for i, b in ok if i != q and (s := score(a, b)) is not None)
            out[q] = [(i, -s) for s, i in scored[:5]]
    return {q: best for q, best in out.items() if best}


@pytest.mark.parametrize("block", [50_000, 200])
def test_exact_top_k(spark, block):
    data = vectors()
    got = defaultdict(list)
    for r in sorted(topk.top_k(embeddings(spark, data), block=block).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == brute_best(data, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))


def test_impact_index_stops_on_proof_before_its_end():
    rng = np.random.default_rng(9)
    values = np.floor(256 * rng.normal(size=(5000, 64)) / 8).astype(np.int64)
    values[:20] = 0
    index = topk.ImpactIndex(topk.segments(values), len(values), 64)
    assert (index.values == values).all()
    postings = 0
    for q in values[20:60]:
        members = index.possible(q, 6)
        postings += index.postings.sum()
        assert set(np.argsort(-(values @ q), kind="stable")[:6]) <= set(members) and len(members) <= 0.02 * len(values)
    print(f"postings touched: {index.touched} of {postings}")
    assert index.touched < 0.95 * postings
    large = topk.ImpactIndex(topk.segments(values * 2**30), len(values), 64)
    assert len(large.possible(values[30] * 2**30, 6)) == len(values)  # sums too large to hold counts: all are rescored


def test_common_bits_estimate_the_cosine():
    rng = np.random.default_rng(10)
    v = rng.normal(size=(3000, 100))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    centre, turn = unit.mean(0), neighbours.rotation(100)
    words, length, fit = neighbours.encode(unit, centre, turn)
    codes = neighbours.Codes([w.tobytes() for w in words], length, fit, centre)
    levels = rng.integers(0, 16, 100)
    planes = neighbours._words((levels >> np.arange(4)[:, None]) & 1)
    signs = (unit - centre) @ turn > 0
    assert codes.common_bits(planes).tolist() == (signs @ levels).tolist()
    inside = []
    for q in unit[:50]:
        guess, slack = codes.estimate(q)
        inside.append((np.abs(guess - unit @ q) <= slack).mean())
    assert np.mean(inside) > 0.95


@pytest.mark.parametrize("block", [50_000, 200])
def test_nearest_neighbours_recall(spark, block):
    data = vectors()

    def cosine(a, b):
        return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) if a.any() and b.any() else None

    got = defaultdict(dict)
    for r in neighbours.nearest(embeddings(spark, data), block=block).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    expected = brute_best(data, cosine)
    assert set(got) == set(expected)
    hits = sum(len(set(got[q]) & {i for i, _ in best}) for q, best in expected.items())
    assert hits / sum(map(len, expected.values())) >= 0.9
    vector = {i: np.array(v, np.float32).astype(float) for i, v, _ in data if v is not None and None not in v}
    assert all(s == pytest.approx(cosine(vector[q], vector[i]), abs=1e-12) for q in got for i, s in got[q].items())


def test_shorter_vectors_are_continued_by_zeros(spark):
    data = [(0, [1.0, 0.0, 1.0], 1), (7, [1.0], 1), (8, [0.0, 1.0, 0.0], 1), (8, [1.0, 0.0, 1.0], 1), (None, [1.0], 1)]
    assert [(r["vec_id"], r["score"]) for r in sorted(topk.top_k(embeddings(spark, data)).collect(), key=lambda r: r["rank"])] == [(8, 131072), (7, 65536), (8, 0)]
    near = sorted(neighbours.nearest(embeddings(spark, data)).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in near] == [8, 7, 8] and near[1]["score"] == pytest.approx(0.5**0.5)


def test_few_candidates_are_all_returned(spark):
    data = [(0, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 1.0], 1)]
    for f in (topk.top_k, neighbours.nearest):
        assert [(r["rank"], r["vec_id"]) for r in sorted(f(embeddings(spark, data)).collect(), key=lambda r: r["rank"])] == [(1, 8), (2, 7)]


# ---- op10 --------------------------------------------------------------------------


def test_window_distances_are_plain_compressed_lengths():
    import zstandard

    toxic, ordinary = b"you utter nitwit and oaf " * 3, b"the calm river runs along the quiet meadow to the harbor and the old mill by the bridge"
    distance = toxicity.Distance(toxic, ordinary)

    def plain(word):
        sizes = []
        for content in (ordinary, toxic + ordinary):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=toxicity.LEVEL)
            packer = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
            sizes.append(len(packer.compress(b" " + word + b" " + ordinary[-toxicity.ENDING :])))
        return sizes[0] - sizes[1]

    text = "The river nitwit " + "q" * 300 + " oaf utter"
    words = ["the", "river", "nitwit", "q" * 96, "q" * 96, "q" * 96, "q" * 12, "oaf", "utter"]
    saved = np.array([plain(w.encode()) for w in words])
    got = distance.features(text)
    assert saved.max() > 0 and got[0] == saved.max() and got[2] == pytest.approx(saved.mean()) and got[1] == pytest.approx(np.sort(saved)[-3:].mean())
    for k, t in enumerate(toxicity.THRESHOLDS):
        assert got[3 + k] == pytest.approx(math.log1p((saved >= t).sum()))


def test_toxicity_learns_from_whole_texts_and_one_row_an_id(spark):
    plain = [(i, prose(i, 60), None, None) for i in range(200)]
    rude = [(1000 + i, prose(500 + i, 12_000 if i < 20 else 40) + " you blithering numbskull", None, None) for i in range(80)]
    labels = spark.createDataFrame([(i, None, int(i >= 1000)) for i, *_ in plain + rude] + [(1000, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, plain + rude + [rude[0]] * 50 + [(None, "numbskull", None, None), (None, None, None, None)])
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(plain) + len(rude) + 52
    judged = [(r["predicted"], int(r["doc_id"] >= 1000)) for r in got if r["doc_id"] is not None and r["held_out"]]
    assert judged and np.mean([p == y for p, y in judged]) > 0.95


# ---- empty tables ------------------------------------------------------------------


@pytest.mark.parametrize("f", [substring.remove_repeats, mixing.mix, simhash.near_duplicates, pii.find_personal_data, language.identify, packing.pack])
def test_empty_documents(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_vectors_and_labels(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(none).count() == 0 and neighbours.nearest(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(spark.createDataFrame([], SCHEMA), labels).count() == 0
        got = f(documents(spark), labels).collect()
        assert len(got) == len(texts()) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
