"""Operators against brute force, over a corpus of awkward rows."""

import hashlib
import math
import os
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, embeddings, graph, html, langid, lm, mixing, sharding, simhash, tokencount, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def least_reachable(n, links, ids):
    """Brute-force components: for each node the smallest id that it reaches."""
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[find(a)] = find(b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least.get(find(i)) for i in range(n)]


@pytest.mark.parametrize(("lanes", "heavy"), [(4, 1000), (2, 5), (None, 1)])
def test_sharding(docs, corpus, lanes, heavy):
    rows = sharding.shard_documents(docs, lanes=lanes, heavy=heavy).collect()
    assert len(rows) == len(corpus)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_sharding_equals_brute_force(docs, corpus):
    """Every row's way down the tree, draw by draw."""
    def placed(key, tree):
        at, path = "", []
        for depth in range(3):
            children = {}
            for s in tree:
                names = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
                if names[depth] == at:
                    children[names[depth + 1]] = children.get(names[depth + 1], 0) + s.weight
            draw = lambda n, w: -math.log((int(hashlib.md5(f"{'null' if key is None else key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
            at = min(children, key=lambda n: (draw(n, children[n]), n))
            path.append(at)
        return int(path[-1].rpartition("/")[2])

    tree = sharding.even_tree(8)
    for r in sharding.shard_documents(docs).collect():
        assert (r.shard, r.grown_shard) == (placed(r.doc_id, tree), placed(r.doc_id, sharding.grown(tree)))


def test_sharding_moves_only_where_weights_change(spark):
    tree = sharding.even_tree(12, regions=3, racks=2)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 0 else 1.0) for s in tree]
    df = spark.range(4000).withColumnRenamed("id", "k")
    df = sharding.place(sharding.place(df, F.col("k"), tree, "a"), F.col("k"), heavier, "b")
    moved = df.filter("a <> b").collect()
    region = {s.shard: s.region for s in tree}
    assert moved and all(region[r.b] == region[0] for r in moved)
    counts = Counter(r.a for r in df.collect())
    assert len(counts) == 12 and max(counts.values()) < 1.5 * min(counts.values())


def test_mixing(docs, corpus):
    rows = mixing.mix(docs, few_rows=3).collect()
    assert len(rows) == len(corpus)
    sizes = defaultdict(int)
    for _, t, _, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= max(longest[s] / 2 + 1, 2 * longest[s]) for s in names)
    again = mixing.mix(docs.repartition(2), few_rows=3).collect()
    assert Counter((r.doc_id, r.copies) for r in rows) == Counter((r.doc_id, r.copies) for r in again)


def brute_mix(rows, weights=(1.0, 2.0, 3.0), most=3, seed=7):
    """Copies of each row of (doc_id, size, text, source) by going through all of a source's documents in order of rank."""
    from fractions import Fraction as Fr

    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    words = {s: sum(r[1] for r in rows if r[3] == s) for s in names}
    weight = {s: Fr(weights[k % len(weights)]) for k, s in enumerate(names)}

    def fill(total, part):  # part: key to (weight, most): shares by weight, none above its most
        full = set()
        while True:
            left, w = total - sum(part[x][1] for x in full), sum(part[x][0] for x in part if x not in full)
            share = {x: left * part[x][0] / w for x in part if x not in full} if w else {}
            over = {x for x, v in share.items() if v > part[x][1]}
            if not over:
                return {x: Fr(part[x][1]) for x in full} | share
            full |= over

    target = fill(sum(words.values()), {s: (weight[s], most * words[s]) for s in names})
    out = []
    for s in names:
        own = [r for r in rows if r[3] == s]
        classes = Counter()
        for r in own:
            classes[len(f"{r[1]:b}")] += r[1]
        due = {c: x / classes[c] for c, x in fill(target[s], {c: (c * n, most * n) for c, n in classes.items() if n}).items()}
        need = target[s] - sum(due[c].__floor__() * classes[c] for c in due)
        ranked = []
        for r in own:
            e = due.get(len(f"{r[1]:b}"), Fr(0))
            u = (int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|{seed}|{'null' if r[2] is None else r[2]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            pi = float(e - e.__floor__())
            ranked.append((u / (1 - u) / (pi / (1 - pi)) if pi > 1e-12 else math.inf, r, e.__floor__()))
        open_, before = True, 0
        for rank, r, whole in sorted(ranked, key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0, x[1][1])):
            open_ = open_ and rank < math.inf and (need - before > 0 if r[1] == 0 else (need - before) / r[1] > 0.5)
            before += r[1]
            out.append((r[0], r[1], whole + open_))
    return out


def test_mixing_equals_brute_force(docs, corpus):
    rows = [(i, len(WORD.findall(t or "")), t, s) for i, t, _, s in corpus]
    want = Counter(x for x in brute_mix(rows) if x[1])
    for few in (1, 10_000):
        got = Counter((r.doc_id, r["size"], r.copies) for r in mixing.mix(docs, few_rows=few).collect() if r["size"])
        assert got == want


def test_mixing_stops_inside_rows_that_are_equal(spark):
    rows = [(1, "a b c d e", "x")] * 400 + [(i, "one two three", "y") for i in range(1000)] + [(None, "p q", "x")] * 7
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6).cache()
    made = mixing.mix(docs, few_rows=5).collect()
    for s in ("x", "y"):
        taken, target = sum(r.taken for r in made if r.source == s), next(r.target for r in made if r.source == s)
        assert abs(taken - target) <= 5, (s, taken, target)
    want = Counter(brute_mix([(i, len(t.split()), t, s) for i, t, s in rows]))
    assert Counter((r.doc_id, r["size"], r.copies) for r in made) == want
    copies = Counter()
    for r in made:
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.apply_mix(docs, few_rows=5).collect()) == +copies


def test_mixing_keeps_columns_and_repeats_rows(docs):
    mixed = mixing.apply_mix(docs, few_rows=3)
    assert mixed.columns == docs.columns
    copies = mixing.mix(docs, few_rows=3).agg(F.sum("copies")).first()[0]
    assert mixed.count() == copies


def brute_fingerprint(t):
    import xxhash

    w = WORD.findall(lower(t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(docs, corpus):
    fps = [brute_fingerprint(t) if len(t or "") < 90_000 else simhash.fingerprint(t) % (1 << 64) for _, t, _, _ in corpus]
    n = len(corpus)
    links = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = Counter((corpus[i][0], f"{fps[i]:016x}", c) for i, c in enumerate(least_reachable(n, links, [r[0] for r in corpus])))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of().alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.keep_first(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 200 in ids and 201 not in ids and sum(r.doc_id is None for r in kept) == 1


def test_simhash_keeps_groups_of_text_not_of_ids(spark):
    a, b, c, d = ("one two three four five", "six seven eight nine ten", "red green blue black white", "north south east west up")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (2, c, "x"), (2, c, "x"), (None, d, "x"), (None, d, "x"), (None, b, "x"), (3, None, "x"), (4, "", "x")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3))
    assert kept.columns == ["doc_id", "text", "fp"]
    # A null text and an empty one are alike, and 3 comes before 4.
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a, "x"), (2, b, "x"), (2, c, "x"), (None, d, "x"), (3, None, "x")])


def test_links_lose_nothing_within_the_distance(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    got = least_reachable(len(fps), [(at[a], at[b]) for a, b in edges], list(range(len(fps))))
    want = least_reachable(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], list(range(len(fps))))
    assert got == want


def test_crowded_cells_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = set()
    for _ in range(7000):
        x = int(base[rng.integers(3)])
        for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
            x ^= 1 << b
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    nodes, label = graph.least_labels(*(np.concatenate(c) for c in zip(*simhash._cell_links(np.zeros(len(fps), np.int64), fps, 3), strict=True)))
    plain = [(a, b) for a, b in simhash._forest(fps, 3)]
    want_nodes, want = graph.least_labels(*(np.concatenate(c) for c in zip(*plain, strict=True)))
    assert len(fps) > simhash.CROWDED and (nodes == want_nodes).all() and (label == want).all()


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    d = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    plain = [sum(abs((x >> 2 * s & 3).bit_count() - (y >> 2 * s & 3).bit_count()) for s in range(32)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert d.tolist() == plain and (d <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5)]
    for few in (0, 20, 1000):  # all by rounds, the last edges in one task, all of them
        roots = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint"), few=few).collect()}
        assert len({roots[i] for i in range(301)}) == 1 and len({roots[x] for x in [1000, 2000, 2299]}) == 1 and roots[0] != roots[1000]


def test_bpe_equals_the_library(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_documents(docs, TOKENIZER, lexicon_words=500, with_ids=True).collect()}
    for i, text, _, _ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        r = got[i, hashlib.sha256(raw).hexdigest()]
        assert bytes(r.ids) == raw and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_frequent_words_are_the_first_by_count(spark):
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(k, " ".join(["x", *words] + words[: 10] * 2 + [words[0]] * 70_000)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counted = {r.word: r.n for r in bpe.word_counts(docs).collect()}
    exact = Counter(w for _, t in rows for w in re.findall(r" ?[^ ]+", t))
    flat = Counter()
    for w, n in exact.items():
        for part in re.findall(r" ?[a-z]+|[0-9]+", w):
            flat[part] += n
    assert counted == flat
    for size in (0, 1, 5, 12, 20, 500):
        got = [r.word for r in bpe.frequent_words(docs, size).collect()]
        assert len(got) == len(set(got)) == min(size, len(flat))
        assert sorted((flat[w] for w in got), reverse=True) == sorted(flat.values(), reverse=True)[:size]
    assert sum(len(r.word) for r in bpe.frequent_words(docs, 500, room=20).collect()) <= 20
    assert bpe.frequent_words(docs.limit(0), 5).collect() == []


def test_words_seen_once_in_each_task_are_counted(spark):
    texts = ["rare", "rare", "rare twice", "twice", "-".join(["ab"] * 200), "x" * 65, "x" * 64, None, "", "\n \n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(10)
    counted = {r.word: r.n for r in bpe.word_counts(docs).collect()}
    assert counted == {"rare": 3, " twice": 1, "twice": 1, "ab": 200, "-": 199, "x" * 64: 1, " ": 1}


def test_lexicon_of_many_words_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    words = {bytes(w): [k] for k, w in enumerate(rng.integers(97, 123, (20_000, 16), dtype=np.uint8))}
    tracemalloc.start()
    blob = bpe.compile_lexicon(words)
    assert tracemalloc.get_traced_memory()[1] < 200 * 16 * len(words)
    tracemalloc.stop()
    lexicon = bpe.Lexicon(blob)
    assert all(np.frombuffer(lexicon.find(w), "<u4").tolist() == ids for w, ids in words.items())
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(b"a") is None


def test_transducer_accepts_its_words_only():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", " top", "a", "é", "stop", "stops"])}
    blob = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(blob)
    assert all(list(np.frombuffer(lexicon.find(w), "<u4")) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"", b"t", b"to", b"topsy", b"xtop"))
    plain = len(bpe.compile_lexicon({w[:-1] + bytes([97 + k]): v for k, (w, v) in enumerate(words.items())}))
    assert len(blob) <= plain  # equal suffixes share states


class RunHere:
    """Stands for a table of one batch: what is mapped over it runs in this process."""

    def __init__(self, batch):
        self.batch, self.value = batch, None
        self.sparkSession = self.sparkContext = self
        self.schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def select(self, *columns):
        return RunHere(self.batch.select(columns))

    def mapInArrow(self, run, schema):
        self.value = list(run(iter([self.batch])))
        return self

    def filter(self, *_):
        return self

    groupBy = agg = filter


def test_bpe_takes_no_steps_of_python_for_each_word(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (6000, 7))]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 6000, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    lexicon = bpe.compile_lexicon({b" " + w.encode(): [k] for k, w in enumerate(words[:100])})
    monkeypatch.setattr(bpe, "build_lexicon", lambda *_: lexicon)
    codec, calls = bpe.Codec(bpe.read_spec(TOKENIZER), lexicon), Counter()
    monkeypatch.setattr(bpe, "codec_of", lambda *_: codec)
    for run in (lambda: bpe.word_counts(RunHere(batch)), lambda: bpe.encode_documents(RunHere(batch), TOKENIZER)):
        calls.clear()
        sys.setprofile(lambda frame, event, _: calls.update([event]) if frame.f_code.co_filename == bpe.__file__ else None)
        try:
            run()
        finally:
            sys.setprofile(None)
        assert calls["call"] < len(words) / 4, calls


def test_bpe_many_texts_at_once_equal_the_library():
    from tokenizers import Tokenizer

    t, spec, rng = Tokenizer.from_file(TOKENIZER), bpe.read_spec(TOKENIZER), np.random.default_rng(6)
    parts = ["a", "th", "ing", "é", "ñ" * 33, "日本", "한", "'s", "1", "½", ".", ",", "!", "-", "x" * 70, "ab" * 40, "\x00", "\u0300", " ", " ", " ", "\n"]
    odd = ["  ", "\n\n", "\xa0 ", "\x85", "\u3000", "\u0558", "😀", "<|endoftext|>"]
    merges = bpe.Merges(spec)
    lexicon = bpe.compile_lexicon({w.encode(): merges.word(w.encode()) for w in [" th", "thing", "a", " a", "é", "."]})
    texts = [None, "", " ", "\n", " a", "a ", "\na", "a\n", "<|endoftext|>"]
    for k in range(300):
        text = "".join(rng.choice(parts + odd * (k % 3 == 0), rng.integers(0, 40)).tolist())
        texts.append(text if k % 3 == 0 else re.sub(r"\s+", lambda m: m[0][0], text))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for codec in (bpe.Codec(spec), bpe.Codec(spec, lexicon)):
        for kind, room in ((pa.string(), 1), (pa.string(), 500), (pa.large_string(), 1 << 23)):
            column = pa.array(["cut off", *texts], kind).slice(1)
            assert 0.1 < codec.odd(column).mean() < 0.5
            got = [ids for some in bpe.groups(column, room) for ids in codec.encode_all(some)]
            assert [x.tolist() for x in got] == want
            assert [codec.decode(x) for x in got] == [t.decode(x, skip_special_tokens=False) for x in want]
        for few in ([], [None], ["", ""], ["a  b"]):
            assert [x.tolist() for x in codec.encode_all(pa.array(few, pa.string()))] == [t.encode(x or "", add_special_tokens=False).ids for x in few]


def test_bpe_words_merged_and_looked_up_together():
    merges, rng = bpe.Merges(bpe.read_spec(TOKENIZER)), np.random.default_rng(7)
    words = [bytes(w) for n in rng.integers(0, 90, 1500).tolist() for w in [rng.choice(list(b"abething s\xc3\xa9"), n).astype(np.uint8)]]
    words += [b"a" * n for n in range(130)] + [b"ab" * n for n in range(70)]
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    begins = np.cumsum(lengths) - lengths
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.words(data, begins, lengths).to_pylist()] == [merges.word(w) for w in words]
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: [k, k] for k, w in enumerate(words[::2])}))
    numbers = lexicon.numbers(data, begins, lengths).tolist()
    lists = lexicon.lists.to_pylist()
    assert [lists[n] if n >= 0 else None for n in numbers] == [lexicon.find(w) for w in words] and -1 in numbers


def test_letters_of_arrow_are_those_of_the_pattern():
    import regex

    settled = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe._SETTLED.search(chr(c))]
    assert pc.match_substring_regex(pa.array(settled), bpe._SIMPLE).to_pylist() == [bool(regex.fullmatch(r"\p{L}", c)) for c in settled]


def test_token_counts_sum_and_follow_the_rule(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for rule in tokencount.RULES:
        rows = tokencount.count_sections(docs, TOKENIZER, rule=rule, sections=tokencount.sentence_ends).collect()
        assert len(rows) == len(corpus) and all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in rows)
    codec = bpe.Codec(bpe.read_spec(TOKENIZER))
    text = "One two. Three four.\nÉté  à la mer! End"
    assert tokencount.char_spans(codec, text) == [tuple(o) for o in t.encode(text).offsets]
    ends, bounds = np.array([3, 4, 9]), np.array([4, 6, 9])
    assert tokencount.attribute(ends, bounds, "first")[0].tolist() == [0, 0, 1]
    assert tokencount.attribute(ends, bounds, "last")[0].tolist() == [0, 0, 2]
    assert tokencount.attribute(ends, bounds, "most")[0].tolist() == [0, 0, 2]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_counts_equal_brute_force(docs, corpus, rule):
    """Section by section, byte by byte, by the library's own tokens: each of their letters stands for a byte."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for sections in (tokencount.sentence_ends, tokencount.line_ends, lambda x: [*range(3, len(x), 3), len(x)] if x else [0]):
        want = Counter()
        for i, text, _, _ in corpus:
            text, counts, crossing = text or "", [], 0
            ends = sections(text)
            section_of = [k for k, (a, b) in enumerate(zip([0, *ends], ends)) for c in text[a:b] for _ in c.encode()]  # noqa: B905
            counts, at = [0] * len(ends), 0
            for token in t.encode(text, add_special_tokens=False).tokens:
                held = section_of[at : at + len(token)]
                at += len(token)
                crossing += held[0] != held[-1]
                counts[held[0] if rule == "first" else held[-1] if rule == "last" else max(sorted(set(held)), key=held.count)] += 1
            want[i, sum(counts), len(ends), crossing, tuple(counts)] += 1
        got = tokencount.count_sections(docs, TOKENIZER, rule=rule, sections=sections).select("doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens").collect()
        assert Counter((*r[:4], tuple(r[4])) for r in got) == want


def test_field_counts(spark):
    df = spark.createDataFrame([(1, "a title", "some body text"), (2, None, ""), (3, "é" * 50, "x\ny")], "i int, title string, body string")
    rows = tokencount.count_fields(df, "i", ["title", "body"], TOKENIZER).orderBy("i").collect()
    assert all(r.tokens.title + r.tokens.body == r.n_tokens for r in rows) and rows[1].n_tokens >= 1
    assert tokencount.count_fields(df.limit(0), "i", ["title", "body"], TOKENIZER).collect() == []


def test_language(docs, corpus, spark):
    model = langid.fit(docs.withColumn("lang", F.when(F.col("lang").isNotNull(), F.col("lang"))))
    rows = langid.identify(docs, model, spans=True).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        lettered = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    # Two languages with letters of their own, and texts that mix them.
    pairs = [(i, ("zala pola kazo " if i % 2 else "thew whing owth ") * 30, "x" if i % 2 else "y") for i in range(60)]
    train = spark.createDataFrame(pairs, "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    labeler = langid.Labeler(model, 6.0)
    mixed = "zala pola kazo zala pola kazo thew whing owth thew whing owth привет"
    spans = labeler.spans(mixed)
    assert [s[2] for s in spans] == ["x", "y", "und"] and mixed[spans[1][0] : spans[1][1]].startswith("thew")
    assert langid.Labeler(langid.fit(train.limit(0)), 6.0).label(["abc"]) == [("und", 0.0, [])]
    for t in (mixed, "  zala 12 pola!  ", "", "12", "thew\u2003whing привет zala"):
        by_word = [(m.start(), m.end()) for m in re.finditer(r"\S+", t) if any(map(str.isalpha, m[0]))]
        spans = labeler.spans(t)
        assert ([spans[0][0], spans[-1][1]] == [by_word[0][0], by_word[-1][1]]) if by_word else spans == []
    sure, unsure = (labeler.label([t])[0][1] for t in ("zala pola kazo zala pola kazo", "zala owth"))
    assert 0 < unsure < sure <= 1


def test_language_of_held_out_documents(spark):
    """Accuracy on the fold that is not learned from, and that the score tells right from wrong."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the fixture tables are not here")
    docs = spark.read.parquet(path)
    rows = langid.identify(docs, langid.fit(docs)).filter("lang is not null").collect()
    rows = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and any(map(str.isalpha, r.text or ""))]
    right = [r.score for r in rows if r.lang_pred == r.lang]
    assert len(rows) > 100 and len(right) > 0.95 * len(rows)
    assert langid.fit(docs, most_langs=2).langs == sorted(x for x, _ in Counter(r.lang for r in docs.collect() if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2).most_common(2))


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(60):
        s = -rng.random((6, 3)) * 8
        best = max(sum(s[t, p[t]] for t in range(6)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in product(range(3), repeat=6))
        p = langid.viterbi(s, 3.0)
        assert math.isclose(best, s[np.arange(6), p].sum() - 3.0 * (np.diff(p) != 0).sum())


def test_language_model(docs, corpus):
    rows = lm.score_documents(docs).collect()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    tokens = [WORD.findall(lower(t or "")) + ["\0"] for _, t, _, _ in corpus]
    counts = Counter(w for (i, _, _, _), ws in zip(corpus, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (i, _, _, _), ws in zip(corpus, tokens, strict=True):
        want[i, held(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    some = [r for r in rows if r.held_out and r.doc_id is not None and 200 <= r.doc_id < 400]
    assert some and all(r.score > r.base_score for r in some)


def exact_model(corpus, modulus=10, alpha=0.1, less=0.99):
    """(tokens of each row, the probability of a token behind another) by exact counts of all training pairs, each taken down to a power of two."""
    tokens = [WORD.findall(lower(t or "")) + ["\0"] for _, t, _, _ in corpus]
    train = [ws for (i, _, _, _), ws in zip(corpus, tokens, strict=True) if zlib.crc32(str(i if i is not None else "").encode()) % modulus]
    single, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["\1", *ws], ws))  # noqa: B905
    n, v, single["\1"] = sum(single.values()), len(single), len(train)
    given = Counter()
    for (h, _), c in pairs.items():
        given[h] += 2 ** (c.bit_length() - 1) - less

    def probability(h, w):
        base = (single[w] * (w != "\1") + alpha) / (n + alpha * (v + 1))
        if not single[h]:
            return base
        seen = 2 ** (pairs[h, w].bit_length() - 1) - less if pairs[h, w] else 0.0
        return seen / single[h] + (1 - given[h] / single[h]) * base

    return tokens, probability, [w for w in single if w != "\1"]


@pytest.mark.parametrize("parts", [None, 1, 700])
def test_language_model_equals_exact_counts(docs, corpus, parts):
    tokens, probability, _ = exact_model(corpus)
    want = sorted((str(i), len(ws), sum(math.log10(probability(h, w)) for h, w in zip(["\1", *ws], ws))) for (i, _, _, _), ws in zip(corpus, tokens, strict=True))  # noqa: B905
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score_documents(docs, parts=parts).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_language_model_sums_to_one(corpus):
    tokens, probability, known = exact_model(corpus)
    for h in ("\1", tokens[0][0], tokens[3][-2], "never seen"):
        assert math.isclose(sum(probability(h, w) for w in known) + probability(h, "never seen"), 1.0, rel_tol=1e-9)


def test_language_model_tells_documents_that_occur_twice(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60).tolist())) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    scored = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gain = {i: r.score / r.n_tokens for i, r in scored.items() if not r.held_out}
    twice = [gain[i] for i in range(30) if i in gain and 1000 + i in gain]
    once = sorted(gain[i] for i in range(30, 400) if i in gain)
    assert sum(g > once[int(0.95 * len(once))] for g in twice) > 0.9 * len(twice)


def test_language_model_steps_leave_no_shuffle_files(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllFiles().mkString(" ")))
    before, setting = shuffles(), spark.conf.get(key, None)
    counts = spark.range(10_000, numPartitions=3).groupBy((F.col("id") % 100).alias("k")).count()
    written = lm._write(counts, str(tmp_path / "counts"))
    deadline = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert shuffles() <= before
    assert written.count() == 100
    with pytest.raises(Exception, match="counts"):
        lm._write(counts, str(tmp_path / "counts"))
    assert spark.conf.get(key, None) == setting


def test_language_model_drops_token_rows_once_summed(docs, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "work_folder", lambda *_: str(tmp_path / "lm"))
    scored = lm.score_documents(docs)
    assert (tmp_path / "lm/blocks/kind=docs").exists() and not (tmp_path / "lm/blocks/kind=tokens").exists()
    first, again = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in scored.collect()) for _ in range(2))
    assert first == again and len(first) == len(corpus)


def test_bloom_admits_hardly_any_other_pair():
    rng = np.random.default_rng(8)
    pairs = np.unique(rng.integers(0, 1 << lm.PAIR_BITS, 100_000, dtype=np.uint64))
    bloom = lm.LogBloom.segment(pairs, np.ones(len(pairs), np.uint64))
    assert (bloom.levels(pairs) == 1).mean() > 1 - 1e-5
    assert (bloom.levels(rng.integers(0, 1 << lm.PAIR_BITS, 1_000_000, dtype=np.uint64)) > 0).mean() < 1e-5


def test_bloom_levels_never_fall_short():
    rng = np.random.default_rng(7)
    pairs = np.unique(rng.integers(0, 1 << lm.PAIR_BITS, 3000, dtype=np.uint64))
    counts = rng.integers(1, 500, len(pairs)).astype(np.uint64)
    levels = lm.LogBloom.segment(pairs, counts).levels(pairs)
    assert (levels >= lm.LogBloom.level(counts)).all() and (levels == lm.LogBloom.level(counts)).mean() > 0.999


def test_ranges_cover_all_values():
    rng = np.random.default_rng(9)
    values = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for parts in (1, 7, 100_000_000):
        cuts = lm._ranges(values, 64, parts)
        assert np.concatenate([values[s] for _, s in cuts]).tolist() == values.tolist() and [p for p, _ in cuts] == sorted({(int(v) >> 32) * parts >> 32 for v in values.tolist()})
    assert lm._ranges(values[:0], 64, 3) == []


VECTORS = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(np.random.default_rng(0).standard_normal((300, 16)))]
VECTORS += [(1000 + i, [x + 0.01 * ((i + k) % 3) for k, x in enumerate(VECTORS[0][1])], 0) for i in range(60)] + [(2000 + i, VECTORS[1][1], 1) for i in range(30)]
VECTORS += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [1.0] * 15 + [None], 1), (3003, [float("nan")] * 16, 1), (3004, [float("inf")] * 16, 1), (3005, VECTORS[1][1], None), (3006, [], 1)]
VECTORS += [(None, VECTORS[1][1], 1), (3007, [1.0, 2.0], 1), (3020, [1.0, 2.0], 1), (3021, VECTORS[0][1], 0), (3021, VECTORS[0][1], 0)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("dim", F.lit("x")).repartition(4)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(vectors):
    got = defaultdict(list)
    for r in topk.top_k(vectors, pivots=5, sample=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert got == brute_top_k([(i, v) for i, v, _ in VECTORS if i is not None and fine(v)])


def brute_top_k(rows, k=20, every=20):
    q, out = [(i, [math.floor(64 * x) for x in v]) for i, v in rows], defaultdict(list)
    for n, (i, v) in enumerate(q):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(q) if m != n and len(w) == len(v))[:k]
            out[i] += [(r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return {i: sorted(x) for i, x in out.items() if x}


def test_top_k_of_repeated_rows_in_many_rounds(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(8) * 0.1]) for i in range(600)]
    rows += [rows[20]] * 30 + [(40, rows[41][1])] * 3 + [(20, [0.0] * 8)] + [(700 + i, rows[60][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in topk.top_k(df, k=5, pivots=12, sample=60, block_rows=3, chunk_rows=7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {i: sorted(x) for i, x in got.items()} == brute_top_k(narrow, k=5)


def test_top_k_of_scores_beyond_64_bits(spark):
    rows = [(0, [1e18, 1.0]), (20, [-1e18, 2.0]), (1, [1e18, -5.0]), (2, [3.0, 4.0]), (3, [1e307, 1.0]), (4, [1e200, 1.0]), (40, [1e200, 1e200])]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=6).collect()}
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows if i != 3}
    for i in (0, 20, 40):
        for j in set(q) - {i}:
            assert got.pop((i, j)) == max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q[i], q[j], strict=True))))
    assert not got


def test_top_k_of_huge_components(spark):
    rows = [(i, [float(10**7 + i), float(-i)]) for i in range(0, 60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=2).filter("rank = 1").collect()
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for r in got:
        assert r.score == max(sum(a * b for a, b in zip(q[r.query_id], w, strict=True)) for j, w in q.items() if j != r.query_id)


@pytest.mark.parametrize(("cells", "tile"), [(None, None), (3, 8), (40, 5)])
def test_embedding_links(vectors, cells, tile):
    rows = embeddings.near_duplicates(vectors, cells=cells, tile=tile).collect()
    assert len(rows) == len(VECTORS)
    good = [k for k, (i, v, lab) in enumerate(VECTORS) if i is not None and lab is not None and fine(v) and any(v)]
    unit = {k: np.array(VECTORS[k][1]) / np.linalg.norm(VECTORS[k][1]) for k in good}
    links = [(a, b) for a in good for b in good if a < b and VECTORS[a][2] == VECTORS[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    comp = least_reachable(len(VECTORS), links, [v[0] for v in VECTORS])
    want = Counter((v[0], degree[k], comp[k] if v[0] is not None else None, v[0] == comp[k] or v[0] is None) for k, v in enumerate(VECTORS))
    assert Counter(map(tuple, rows)) == want


def test_embedding_recall_and_growth(spark):
    """Clusters about the threshold, at two sizes: links found against brute force, and the copies that are dealt for each vector."""
    rng = np.random.default_rng(12)
    for n in (600, 2400):
        centres = rng.standard_normal((n // 12, 64))
        x = (np.repeat(centres, 12, axis=0) + rng.standard_normal((n, 64)) * 0.1).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
        found = sum(r.n_links for r in embeddings.near_duplicates(df, cells=max(16, n // 64)).collect())
        u = embeddings.unit(x.astype(np.float64))
        same = (np.arange(n)[:, None] - np.arange(n)[None]) % 2 == 0
        want = int(((u @ u.T >= 0.98) & same).sum()) - n
        assert want > n and want * 0.99 <= found <= want
        _, who, _ = embeddings.cells_of(u, max(16, n // 64), 3.5, 0.98)
        assert len(who) < 8 * n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="advert box">Buy <b>now</b></div>
<article><h1>The story</h1><p>First&nbsp;par &amp; more<br>line two &lt;3<p>Second   <b>bo</b>ld<aside>aside words</aside><p>Third.</article>
<div id=comments><p>I like it a lot</p></div><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &amp; simple"), (5, "u", PAGE), (6, "u", "<p title='x>a</p><!-- b"), (7, "u", "<script>x")], "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in html.extract(df, html.fit(df)).collect()}
    story = "The story\nFirst par & more line two <3\nSecond bold\nThird."
    assert rows[1].text == story == rows[5].text and rows[1].n_chars == len(story)
    assert [rows[k].text for k in (2, 3, 4, 6, 7)] == ["", "", "plain & simple", "a", ""]
    assert html.main_text(PAGE.replace("article", "section"), html.Weights.of({})) == story
    odd = df.selectExpr("*", "1 as text", "2 as n_chars", "'x' as score").repartition(3)
    assert {r.page_id: r.text for r in html.extract(odd, html.fit(odd)).collect()} == {k: r.text for k, r in rows.items()}


ARTICLE = "<p>" + " ".join(f"word{i}" for i in range(120)) + "</p>"


@pytest.fixture(scope="module")
def fitted():
    import pyarrow.parquet as pq

    counts = [Counter(), Counter()]
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = [h or "" for h in pq.read_table(path).column("html").to_pylist()] if os.path.exists(path) else [PAGE] * 5
    for h in pages[::2]:
        for c, x in zip(counts, html.observed(h, html.Weights.of({})), strict=True):
            c.update(x)
    return html.Weights.of({k: (counts[0][k], counts[1][k]) for k in counts[0].keys() | counts[1].keys()}), pages[1::2]


@pytest.mark.parametrize("learned", [False, True])
def test_marks_do_not_decide_alone(fitted, learned):
    w = fitted[0] if learned else html.Weights.of({})
    text = lambda body: html.main_text(f"<html><body>{body}<footer><p>foot note that is long enough to be taken for content</p></footer></body></html>", w)
    words = " ".join(f"word{i}" for i in range(120))
    assert text(f'<nav><a href=/>x</a></nav><div class="social-history">{ARTICLE}</div>') == words
    assert text(f'<div id="main-banner-story">{ARTICLE}</div>') == words
    ad, share = '<p class="ad">Buy this great thing right now for ten only</p>', '<p>end <span class="share">Share this</span>.</p><p>Of.</p>'
    comment = '<article class="comment"><p>I liked this story a lot and will read it again with my friends because it is so good</p></article>'
    assert text(f"<article>{ARTICLE}{ad}{share}</article>{comment}") == f"{words}\nend .\nOf."
    soup = f'<div class="wrap has-sidebar"><div class="site-header">Big site</div><div class="cookie-banner"><p>{"We use cookies and so do our many partners, please accept. " * 3}</p></div>'
    soup += f'<div class="post">{ARTICLE}<div class="ad-slot">Buy now</div>{ARTICLE}</div><div class="sidebar"><p>{"more stuff " * 30}</p></div>'
    soup += f'<div id="comments"><ol class="comment-list"><li class="comment"><p>{"I think so " * 20}</p></li></ol></div></div>'
    assert text(soup) == f"{words}\n{words}"


def test_main_text_of_held_out_pages(fitted):
    """Pages that were not learned from, with their marks taken away, against what they marked."""
    w, pages = fitted
    shares = []
    for h in pages:
        want, got = (Counter(html.main_text(x, w).split()) for x in (h, h.replace("<article>", "<div>").replace("</article>", "</div>")))
        both = sum((want & got).values())
        shares.append((both / max(1, sum(got.values())), both / max(1, sum(want.values()))))
    assert min(np.mean(shares, axis=0)) > 0.95


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    w = html.Weights.of({})
    for one in ("<div>", "<p class=x><b>a ", "<li>a", "</div>", "<a href='", "<!", "<span class=ad>b</span> c "):
        took = []
        for n in (4_000, 16_000):
            start = time.perf_counter()
            html.main_text(one * n, w)
            took.append(time.perf_counter() - start)
        assert took[1] < 8 * took[0] + 0.5, one


def test_best_region_equals_all_regions():
    rng = np.random.default_rng(9)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(1, 9)).astype(float).tolist()
        a, b = html.region(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0)
        assert sum(s[a:b]) == max(0, best)


def test_empty_tables(nothing, spark):
    for made in (
        sharding.shard_documents(nothing), mixing.mix(nothing), mixing.apply_mix(nothing), simhash.near_duplicates(nothing), simhash.keep_first(nothing), lm.score_documents(nothing),
        bpe.encode_documents(nothing, TOKENIZER), tokencount.count_sections(nothing, TOKENIZER), langid.identify(nothing, langid.fit(nothing)),
    ):
        assert made.collect() == []
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert topk.top_k(empty).collect() == [] and embeddings.near_duplicates(empty).collect() == []
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.extract(pages, html.fit(pages)).collect() == []
