"""Operators against brute force, the tokenizers themselves, exact round trips, and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimloom.llm import line_dedup, media, mixing, ordinal, packing, recompression, simhash, suffix_index, token_counts, winnowing


class Sets:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def test_token_counts(docs, small):
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t for _, t, _ in small], add_special_tokens=False)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert got == {i: (len(t.encode()), len(e.ids)) for (i, t, _), e in zip(small, want, strict=True)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_token_count_of_any_text(text):
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    want = _tokenizer().encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(want)


_cached: list = []


def _tokenizer():
    if not _cached:
        _cached.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return _cached[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_encoder_gives_the_tokenizer_s_ids(texts):
    e = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.encode(texts) == e.whole(texts)


def test_packing(docs, small):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x for _, x, _ in small], add_special_tokens=False)]
    rows = packing.pack_documents(docs, capacity=128).collect()
    want = {(d, k, s, len(a[s : s + 128]), zlib.crc32(a[s : s + 128].tobytes())) for (d, _, _), a in zip(small, ids, strict=True) for k, s in enumerate(range(0, len(a), 128))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    bins: list[int] = []
    for length in sorted((r.length for r in rows), reverse=True):  # plain best-fit decreasing
        fitting = [k for k, b in enumerate(bins) if b + length <= 128]
        if fitting:
            bins[max(fitting, key=bins.__getitem__)] += length
        else:
            bins.append(length)
    assert len(used) <= len(bins)
    made = {r.sequence_id: r.ids for r in packing.sequences(docs, capacity=128).collect()}
    assert sum(map(len, made.values())) == sum(len(a) for a in ids)


def optimum(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins)}.values()):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        instance = packing.Instance(Counter(sizes), capacity)
        fixed = instance.reduce()
        rest = [x for x in instance.lengths for _ in range(int(instance.left[x]))]
        assert fixed + optimum(sorted(rest, reverse=True), capacity) == optimum(sizes, capacity), sizes
        plan, _, bins = packing.packing_plan(Counter(sizes), capacity)
        assert sum(b - a for _, a, b, _, _, _ in plan) == len(sizes) and bins >= optimum(sizes, capacity)


def test_mixing(docs, small):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in small}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"]
        by[small[r.doc_id][2]].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total = {s: sum(r["size"] for r in by[s]) for s in order}
    free, target = set(order), {}
    left = sum(total.values())
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * total[s]]
        if not over:
            break
        for s in over:
            free.discard(s)
            target[s] = 3 * total[s]
            left -= target[s]
    target |= {s: left * weight[s] / w for s in free}
    for s in order:
        assert {r.source_size for r in by[s]} == {total[s]} and by[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1


def test_substring_dedup(docs, small):
    split = [t.encode().split() for _, t, _ in small]
    first = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in enumerate(split):
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.dedup(docs).collect()} == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for letters in (2, 3, 5, 50) * 5:
        docs = [rng.integers(0, letters, 1000).astype(np.uint64) for _ in range(5)] + [np.full(60, 3, np.uint64)]
        names, fence, first = recompression.lay_out(docs)
        keys, seen = recompression.anchors(names, fence), {}
        for f, d in zip(first, docs, strict=True):
            for k in range(len(d) - 12):
                assert seen.setdefault(d[k : k + 13].tobytes(), keys[f + k]) == keys[f + k]


def spans_of(raws, length):
    count = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    for b in raws:
        held = []
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if held and i <= held[-1][1]:
                    held[-1][1] = i + length
                else:
                    held.append([i, i + length])
        yield held


@pytest.mark.parametrize("length,gram,batches", [(400, 200, 4), (60, 30, 3), (60, 20, 1)])
def test_suffix_dedup(docs, small, length, gram, batches):
    raws = [t.encode() for _, t, _ in small]
    want = {}
    for (i, _, _), raw, held in zip(small, raws, spans_of(raws, length), strict=True):
        kept, at = b"", 0
        for a, b in held:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        want[i] = (len(raw), len(raw) - len(kept), len(held), hashlib.sha256(kept).hexdigest())
    got = suffix_index.dedup(docs, length=length, gram=gram, batches=batches).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def marks(text):
    """By the plain definition: a hash of each run of tokens by itself, the least of each window, rightmost of equals."""
    tokens = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        tokens += [run] if len(run) <= winnowing.PIECE else list(run)
    values = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    k = min(winnowing.GRAM, len(values))
    hashes = []
    for i in range(max(1, len(values) - k + 1) if k else 1):
        h = 0
        for v in values[i : i + k]:
            h = (h << 1 | h >> 63) & (1 << 64) - 1 ^ v
        h &= 0xFFFFFFFF
        hashes.append(h - (1 << 32) if h >> 31 else h)
    grams = len(hashes)
    picked = [min(range(i, min(grams, i + winnowing.WINDOW)), key=lambda j: (hashes[j], -j)) for i in range(max(1, grams - winnowing.WINDOW + 1))]
    return list(dict.fromkeys((hashes[p] << 32) + 0xFFFFFFFF - (p + 1) for p in picked))


def test_shifted_passages_share_marks(spark):
    """Every passage of WINDOW + GRAM - 1 tokens leaves a common mark, in unspaced text at any offset."""
    rng = random.Random(12)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2000))
    short = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(winnowing.WINDOW + winnowing.GRAM - 1))
    spaced = " ".join(f"w{rng.randrange(500)}" for _ in range(winnowing.WINDOW + winnowing.GRAM - 1))
    pairs = [(chinese, "字" + chinese), ("天地玄黃宇宙洪荒天地玄黃宇宙洪荒" + short, "x" * 40 + short + "y" * 30), ("one two " + spaced + " three", "four " + spaced)]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.doc_id: {m >> 32 for m in r.marks} for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[0] & got[1]) >= 0.98 * len(got[0])
    assert all(got[2 * i] & got[2 * i + 1] for i in range(len(pairs)))


def test_winnowing(docs, small):
    def share(a, b):
        a, b = {m >> 32 for m in a}, {m >> 32 for m in b}
        return len(a & b) / len(a | b)

    def shown(m):
        return " ".join(f"{x & (1 << 64) - 1:X}" for x in m)

    got = {r.doc_id: r for r in winnowing.edited_fingerprints(docs).collect()}
    texts = [t for _, t, _ in small]
    for i, t in enumerate(texts):
        following, k = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        a, b, c = marks(t), marks(edited), marks(following)
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), shown(a), shown(b), hashlib.sha256(edited.encode()).hexdigest()), i
        assert r.near_edited == pytest.approx(share(a, b)) and r.near_next == pytest.approx(share(a, c))
    simple = {r.doc_id: r.fingerprint for r in winnowing.fingerprints(docs).collect()}
    assert simple == {i: r.fingerprint for i, r in got.items()}


def edit_distance(a, b):
    """Bit-parallel over the columns of the table of distances, with whole numbers as bit vectors."""
    if not a:
        return len(b)
    at, every, last = defaultdict(int), (1 << len(a)) - 1, 1 << len(a) - 1
    for i, x in enumerate(a):
        at[x] |= 1 << i
    up, down, distance = every, 0, len(a)
    for y in b:
        match = at.get(y, 0)
        zero = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(zero | up) & every, up & zero
        distance += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(zero | right)) & every, right & zero & every
    return distance


def bits(hashes):
    if not hashes:
        return 0
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_line_dedup(docs, small):
    """Against all pairs of lines by edit distance in characters: no line goes without a link, and nearly all that have one go."""
    norm = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")
    places, at = [], {}
    for i, t, _ in small:
        for k, x in enumerate(t.split("\n")):
            if norm(x):
                places.append((i, k, at.setdefault(norm(x), len(at))))
    lines = list(at)
    sets, links = Sets(len(lines)), 0
    for a, b in combinations(range(len(lines)), 2):
        x, y = lines[a], lines[b]
        most = int(max(len(x), len(y)) * 0.2 + 1e-9)
        if abs(len(x) - len(y)) <= most and sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values()) <= 2 * most and edit_distance(x, y) <= most:
            sets.join(a, b)
            links += 1
    stays = {}
    for i, k, x in places:
        stays.setdefault(sets.find(x), (i, k))
    want = {(i, k) for i, k, x in places if stays[sets.find(x)] != (i, k)}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(docs).collect()}
    gone = set()
    for i, t, _ in small:
        before, after = t.split("\n"), got[i][0].split("\n") if got[i][2] < got[i][1] else []
        assert got[i][1:] == (len(before), len(before) - len(after))
        for k, x in reversed(list(enumerate(before))):  # of equal lines of a document the earlier stays
            if after and after[-1] == x and ((i, k) not in want or x not in before[:k]):
                after.pop()
            else:
                gone.add((i, k))
        assert not after
    assert links and len(want) > 10
    assert gone <= want and len(gone) >= 0.9 * len(want)


def test_simhash(docs, small):
    prints = []
    for _, t, _ in small:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(bits([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]))
    sets = Sets(len(small))
    for a, b in combinations(range(len(small)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            sets.join(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", sets.find(i)) for i in range(len(small))}


def test_no_link_is_lost(spark):
    """Chains and clusters of fingerprints: components by pigeonring keys equal those of all pairs."""
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    sets = Sets(len(prints))
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            sets.join(a, b)
    want = defaultdict(set)
    for i, p in enumerate(prints):
        want[sets.find(i)].add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = defaultdict(set)
    for r in simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp long")).collect():
        got[r.root].add(r.fp & (1 << 64) - 1)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500) | st.integers(0, 3 * media.UNIT).map(bytes))
def test_media_round_trip(payload):
    payload += bytes(-len(payload) % 64 if payload else 64)
    got = media.decode(media.encode(payload))
    assert got["payload"] == payload and got["errors"] == 0 and got["programs"] == {1: media.PROGRAM_MAP_PID} and got["streams"] == {media.DATA_PID: media.PRIVATE_DATA}
    assert [t for t, _ in got["times"]] == [k * media.TICKS for k in range(-(-len(payload) // media.UNIT))]
    assert got["random_access"] == [p for _, p in got["times"]]


def test_media_damage_is_noticed():
    stream = media.encode(bytes(range(256)) * 500)
    lost = stream[: 188 * 20] + stream[188 * 21 :]
    assert media.decode(lost)["errors"] == 1 and media.decode(stream + b"x")["errors"] == 1


def test_media_columns(docs, small):
    rows = media.digests(media.encode_column(docs)).collect()
    for r in rows:
        raw = small[r.doc_id][1].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    parsed = media.decode_column(media.encode_column(docs)).select("doc_id", "payload", "errors", "random_access").collect()
    assert all(r.errors == 0 and r.random_access for r in parsed)


def test_classifier_on_held_out_rows(spark, sf_dir):
    """Fitted on one half of the labelled rows, it ranks the other half far better than chance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(2)
    clean = [" ".join(rng.choice(WORD) for _ in range(rng.randint(20, 200))) for _ in range(300)]
    bad = [" ".join(rng.choice(WORD) if rng.random() < 0.9 else rng.choice(["scum", "moron"]) for _ in range(rng.randint(20, 200))) for _ in range(80)]
    loud = [" ".join(w.upper() + "!!" for w in t.split()) for t in clean[:60]]
    rows = [(i, t, g) for i, (t, g) in enumerate([(t, 2) for t in clean] + [(t, 1) for t in bad + loud])]
    rng.shuffle(rows)
    half = len(rows) // 2
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = ordinal.fit_on(table, spark.createDataFrame([(i, g) for i, _, g in rows[:half]], "id long, grade int"))
    kept = {r.doc_id: r.keep for r in ordinal.classify(table, model).collect()}
    held = rows[half:]
    assert sum(kept[i] for i, _, g in held if g == 2) >= 0.97 * sum(g == 2 for _, _, g in held)
    assert sum(not kept[i] for i, _, g in held if g == 1) >= 0.9 * sum(g == 1 for _, _, g in held)
    again = ordinal.fit_on(table.repartition(3), spark.createDataFrame([(i, g) for i, _, g in rows[:half]], "id long, grade int"))
    assert np.array_equal(model.weights, again.weights) and docs.count() > 0


WORD = [f"word{i}" for i in range(300)]


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 500, 20)).astype(np.int32), None) for _ in range(90)]
    rows = [(f, np.ones(len(f), np.int64)) for f, _ in rows]
    model = ordinal.fit(rows, np.array([i % 3 for i in range(90)]))
    assert np.all(np.diff(model.thresholds) > 0)


def test_damaged_streams_decode(small):
    """No damage makes the decoder fail, and whole streams have no errors."""
    rng = random.Random(3)
    for n in range(4000):
        payload = bytes(rng.randrange(256) for _ in range(64 * rng.randint(1, 20)))
        whole = media.encode(payload)
        assert n > 200 or (media.decode(whole)["payload"], media.decode(whole)["errors"]) == (payload, 0)
        stream = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            kind, at = rng.randrange(4), rng.randrange(max(1, len(stream)))
            if kind == 0 and stream:
                stream[at] = rng.randrange(256)
            elif kind == 1:
                del stream[at : at + rng.choice([1, 4, 188, 200])]
            elif kind == 2:
                stream[at:at] = bytes(rng.randrange(256) for _ in range(rng.choice([1, 188])))
            elif len(stream) > 188:
                place = at // 188 * 188 + rng.randrange(12)
                stream[place : place + 1] = bytes([rng.randrange(256)])
        got = media.decode(bytes(stream))
        assert got["errors"] >= 0 and len(got["payload"]) <= len(stream)
