"""Fill-in-the-middle, token counts and the conversation trie, against plain restatements."""

import hashlib
import math
import random
import re
import zlib

import pytest
from fixtures import documents, prose, texts
from pyspark.sql import functions as F

from tallyspark.llm import infill, prefix_trie, token_counts

ODD = [
    (21, "a <P> b c d", "en", "web"), (22, "\x0bmixed  space  x  ", "en", "web"), (23, " \U0001f600 é  \x1f y\r\n", "en", "web"), (24, "word", "en", "web"),
    (25, "<", "en", "web"), (26, "S> <S M> <", "en", "web"), (1, prose(1, 200), "en", "web"), (1, "other text of one id", "en", "web"), (None, "no id at all here", "en", "web"), (None, None, None, None),
]


def arranged(text, doc_id, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cutting(spark):
    data = texts() + ODD + [(1000 + i, prose(i, i % 9), "en", "web") for i in range(200)]
    made = infill.fill_in_middle(documents(spark, data))
    back = made.withColumn("text", infill.restored(F.col("output"), F.col("form")))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, *arranged(t, i), t or "") for i, t, *_ in data), key=str)
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters_and_empty_table(spark):
    docs = documents(spark, [(i, prose(i, 30), "en", "web") for i in range(60)])
    marks = ("[[p]]", "[[s]]", "[[m]]")
    made = infill.fill_in_middle(docs, seed=5, rate=100, spm_rate=0, markers=marks)
    assert {r["form"] for r in made.collect()} == {"psm"}
    texts_back = made.select("doc_id", infill.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in texts_back} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert infill.fill_in_middle(docs.filter("false")).count() == 0
    for bad in (("aa", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, markers=bad)


def library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def hard_texts():
    rng = random.Random(3)
    pool = "aZ9 \n\t'.,-_é́ß中あ  ​😀١٣Ⅷ²͸՘\U00031350'sre'll\x00\x1c\u0085"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return made + ["a<|endoftext|>b  <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof text|>", "x" * 5000, " " * 3000 + "y", "=-" * 400, "I'LL it's we're 'd"]


def test_token_counts_equal_the_librarys(spark):
    data = texts() + ODD + [(2000 + i, t, "en", "web") for i, t in enumerate(hard_texts())]
    whole = library()
    want = sorted((str(i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for i, t, *_ in data)
    for ahead in (0, 40, token_counts.AHEAD):
        got = token_counts.count_tokens(documents(spark, data), limit=100, ahead=ahead).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(documents(spark, data).filter("false")).count() == 0


def test_token_splitter_equals_the_librarys_on_every_code_point():
    """Splitting depends on a code point's class alone, so contexts of every class show differences."""
    split = token_counts.splitter(token_counts.VOCABULARY)
    own = split.own.pre_tokenize_str
    for low in range(0, 0x110000, 256):
        chars = [chr(c) for c in range(low, low + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}2 .{c}! {c} {c}{c}x" for c in chars if not split.unassigned.match(c))
        want = [text[a:b] for _, (a, b) in own(text)] if text else []
        assert split.pattern.findall(text) == want, hex(low)
        assert low >= 0x10000 or split.basic.findall(text) == want, hex(low)
        assert all(bool(split.beyond.match(c)) == (low >= 0x10000 or bool(split.unassigned.match(c))) for c in chars)
    assert split.unassigned.match("͸") and not split.unassigned.match("é")


def trie(conversations, every=20, most=4, rebuild=True):
    """All nodes by listing every prefix of every conversation."""
    turns = {}
    for conv, turn, role, text in conversations:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))

    def digest(t):
        return hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()

    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, ts in turns.items()}
    built = own
    if rebuild:
        built = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if q) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, turns int, key int, words string, part int"


def conversations(spark, data):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in data], SCHEMA).repartition(5)


def random_conversations(seed, n, hot=0):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(0, 5) if c >= hot else 3):
            out.append((c, t, rng.choice(["user", "bot", None]) if c >= hot else "user", rng.choice(["hello there", "yes", "", None, "one two three four"]) if c >= hot else f"the same turn {t}"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_listing_all_prefixes(spark, seed):
    data = random_conversations(seed, 120, hot=40)
    data += [(7001, 1, "a", "tie"), (7001, 1, "a", "tie"), (7001, 1, "b", "other"), (7001, None, "z", "first"), (None, 1, "a", "no id"), (-37, 0, "user", "negative"), (-20, 0, "user", "base of it")]
    for per_task in (10, 60, 200_000):
        got = prefix_trie.conversation_trie(conversations(spark, data), turns_per_task=per_task)
        assert got.columns == list(prefix_trie.COLUMNS)
        assert sorted(map(tuple, got.collect()), key=str) == trie(data)


def test_trie_of_one_path_and_of_copies(spark):
    """One conversation many times, split over partitions; a long one; one without turns."""
    data = [(c, t, "u", f"turn {t}") for c in range(1, 300) for t in range(3)] + [(900, t, "u", f"turn {t}") for t in range(400)]
    plain = prefix_trie.turn_arrays(conversations(spark, data))
    bare = spark.createDataFrame([(5000, [])], plain.schema)
    got = prefix_trie.prefix_trie(plain.unionByName(bare), turns_per_task=40)
    nodes = {r["depth"]: r for r in got.collect()}
    assert len(nodes) == 401 == got.count()
    assert nodes[0]["n_convs"] == 301 and nodes[0]["n_leaves"] == 1 and nodes[0]["ends_sha256"] == hashlib.sha256(b"5000").hexdigest()
    assert nodes[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1, 300))).encode()).hexdigest()
    assert nodes[0]["saved_tokens"] == 3 * 299 * 2 and nodes[3]["saved_tokens"] == 299 * 2 and nodes[400]["ends_sha256"] == hashlib.sha256(b"900").hexdigest()
    assert [nodes[d]["parent_conv_id"] for d in (0, 1, 4, 5)] == [None, 1, 1, 900]


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.conversation_trie(conversations(spark, random_conversations(1, 3)).filter("false")).count() == 0




def test_token_counts_of_the_whole_table(spark):
    from tallyspark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    whole = library()
    texts_of = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, folder).collect()}
    counts = {i: len(whole.encode(t, add_special_tokens=False)) for i, t in texts_of.items()}
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 1024) for i, t in texts_of.items()}
