"""Operators with a stated result against brute force."""

import functools
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from defectflow.llm import mixing, quality, simhash, substring_dedup, token_files
from tests.llm.helpers import CLASH, EDGES, documents, plain, split, with_clashes


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


# quality rules


def brute_quality(text):
    w, t = split(text), text or ""
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    n, chars, symbols, dups, rep = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
    base = n < 50 or 100 * rep > 50 * n
    kept = not base and not (10 * symbols > n or chars < 3 * n or chars > 12 * n or 2 * dups > len(lines))
    return n, chars, symbols, dups, rep, base, kept


def test_quality(spark, sf_dir, tmp_path):
    rows = EDGES + documents(sf_dir, spark)
    with_clashes(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(quality.op1_quality_rules(spark, str(tmp_path)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted(((d, *brute_quality(t)) for d, t, _ in rows), key=key)


def test_quality_order_does_not_change_results(spark):
    docs = plain(spark, EDGES + [(20, "good words here " + " ".join(f"word{i}" for i in range(80)), "a")])
    kept = {tuple(r) for r in quality.keep_good(docs).select("doc_id").collect()}
    again = {tuple(r) for r in quality.quality_report(docs, quality.RULES[::-1]).where("rejected_by is null").select("doc_id").collect()}
    assert kept == again == {(20,)}
    names = [r.name for r in quality.RULES]
    for order in (names, names[::-1]):
        first = {r["doc_id"]: r["rejected_by"] for r in quality.quality_report(docs, order=order).where("doc_id in (2, 20)").collect()}
        assert first == {2: "few_words", 20: None}
    assert quality.keep_good(docs, order=names[::-1]).count() == 1
    ranks = [e.rank for e in quality.estimate_rules(docs)]
    assert ranks == sorted(ranks, reverse=True)


# substring dedup


def brute_dedup(rows, window):
    seen = Counter()
    for _, t, _ in rows:
        w = split(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for d, t, _ in rows:
        w = split(t)
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize(("window", "anchor"), [(35, 16), (5, 2), (3, 3)])
def test_substring_dedup(spark, sf_dir, window, anchor):
    rows = EDGES + documents(sf_dir, spark)
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(500, "a b " + shared + " c", "a"), (501, shared[:200] + " z " + shared, "a"), (502, " ".join(f"s{i}" for i in range(20, 57)), "a")]
    got = collected(substring_dedup.dedup_substrings(with_clashes(spark, rows), window, anchor), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_dedup(rows, window), key=key)


def test_factors_cover_what_is_removed(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(a), "x"), (2, " ".join(b), "x"), (3, " ".join(["q", *a, *b, "r"]), "x"), (4, " ".join(a[20:] + b[:20]), "x")]
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(plain(spark, rows)).collect()}
    assert out[3]["kept_text"] == "q r" and out[4]["kept_text"] == ""
    assert len(out[3]["starts"]) >= 2, "the passage across two references is found at the boundary"
    for r in out.values():
        covered = {i for s, n in zip(r["starts"], r["lengths"], strict=True) for i in range(s, s + n)}
        assert len(covered) == r["n_removed"]


@pytest.mark.parametrize("window", [35, 4])
def test_factors_are_a_relative_parse(spark, sf_dir, window):
    """Each factor equals its reference at its place, which is elsewhere; neighbours in text and reference are one factor; a plain parse by sets covers the same words."""
    rows = EDGES + documents(sf_dir, spark) + [(800, "a b c d e " * 30, "x"), (801, "q a b c d e a b c d e z", "x"), (802, " ".join(f"u{i % 50}" for i in range(130)), "x")]
    keyed = {r["k"]: split(r["t"]) for r in plain(spark, rows).selectExpr(f"xxhash64(coalesce(text, '')) & {(1 << substring_dedup.TEXT_BITS) - 1} k", "coalesce(text, '') t").collect()}
    copies, seen = Counter(), set()
    for _, t, _ in rows:
        w = split(t)
        copies[t or ""] += 1
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    key_of = {" ".join(w): k for k, w in keyed.items()}
    texts = defaultdict(list)
    for d, t, _ in rows:
        texts[d].append(t or "")
    n_factors = 0
    for r in substring_dedup.dedup_substrings(plain(spark, rows), window, min(16, window)).collect():
        if len(texts[r["doc_id"]]) > 1 and len(set(texts[r["doc_id"]])) > 1:
            continue
        text = texts[r["doc_id"]][0]
        w, own = split(text), key_of[" ".join(split(text))]
        factors = list(zip(r["starts"], r["lengths"], r["refs"], r["ref_starts"], strict=True))
        n_factors += len(factors)
        for start, length, ref, place in factors:
            assert length >= window and w[start : start + length] == keyed[ref][place : place + length]
            assert (ref, place) != (own, start) or copies[text] > 1
        for (s0, n0, f0, p0), (s1, _, f1, p1) in zip(factors, factors[1:], strict=False):
            assert s1 > s0 and not (f0 == f1 and s1 - s0 == p1 - p0 and s1 <= s0 + n0 - window + 1)
        if r["doc_id"] == 800:
            assert len(factors) <= 7, "a periodic text refers to itself"
    assert n_factors > 20


# simhash


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = split(w)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("tile", [512, 2])
def test_simhash(spark, sf_dir, tile):
    rows = EDGES + documents(sf_dir, spark)
    prints = [brute_print(t) for _, t, _ in rows]
    roots = brute_components(prints)
    first = defaultdict(list)
    for (d, _, _), p in zip(rows, prints, strict=True):
        first[roots[p]].append(d)
    want = [(d, p - (1 << 64) if p >> 63 else p, min((x for x in first[roots[p]] if x is not None), default=None)) for (d, _, _), p in zip(rows, prints, strict=True)]
    got = collected(simhash.near_duplicates(with_clashes(spark, rows), tile=tile), "doc_id", "fp", "component_id")
    assert got == sorted(want, key=key)


@pytest.mark.parametrize(("tile", "bits"), [(512, 4), (3, 4), (3, 3), (2, 0)])
def test_links_keep_all_components(spark, tile, bits):
    rng = np.random.default_rng(1)
    prints = [0]
    for _ in range(300):
        v = prints[rng.integers(len(prints))]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            v ^= 1 << int(b)
        prints.append(v)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile, bits)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = brute_components([p & (1 << 64) - 1 for p in signed], bits)
    groups = defaultdict(set)
    for p in signed:
        groups[want[p & (1 << 64) - 1]].add(p)
    for group in groups.values():
        assert {found.get(p, p) for p in group} == {min(group)}


def test_components_of_paths_and_hubs(spark):
    """Long paths in mixed order, a hub with most nodes, and a cycle."""
    rng = np.random.default_rng(3)
    names = rng.permutation(4000)
    pairs = [(names[i], names[i + 1]) for i in range(300)] + [(names[500], names[i]) for i in range(501, 3500)] + [(names[3600 + i], names[3600 + (i + 1) % 50]) for i in range(50)]
    edges = spark.createDataFrame([(int(min(p)), int(max(p))) for p in pairs], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    for group in (names[:301], names[500:3500], names[3600:3650]):
        assert {found[int(x)] for x in group} == {int(min(group))}
    assert len(found) == 301 + 3000 + 50


def test_keep_one(spark):
    same = "other words are in this text"
    rows = [(3, "a b c d e f", "s"), (1, "A b c d e f", "s"), (2, same, "s"), (2, same, "s"), (None, "a b c d e f", "s"), (None, "nobody else has this one", "s"), (None, "nobody else has this one", "s"), (2, "not near the first text of two", "s")]
    out = simhash.keep_one(with_clashes(spark, rows))
    assert out.columns == with_clashes(spark, rows).columns
    assert collected(out, "doc_id", "text") == sorted([(1, "A b c d e f"), (2, same), (2, "not near the first text of two"), (None, "nobody else has this one")], key=key)


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, np.int64)) if gaps else np.zeros(0, np.int64)
    ef = token_files.EliasFano.encode(values)
    again = token_files.EliasFano(ef.n, ef.low_bits, ef.low, ef.high, ef.samples.tobytes())
    assert [again.select(i) for i in range(ef.n)] == values.tolist() == again.decode().tolist()
    if len(values) > 100:
        assert (len(ef.low) + len(ef.high)) * 8 <= ef.n * (ef.low_bits + 4) + 16


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(token_files.tokenizer_text())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@functools.cache
def encoder_once():
    return token_files.Encoder(token_files.tokenizer_text())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n 'sdtl1!é漢a "), max_size=40))
def test_pieces_encode_as_the_whole(text):
    encoder = encoder_once()
    assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, sf_dir):
    rows = EDGES + documents(sf_dir, spark) + [(-(1 << 61), "far below", "a"), ((1 << 62) + 5, "far above", "a"), (1 << 62, "far above", "a"), (None, "zz", "a"), (None, "a", "b")]
    docs = with_clashes(spark, rows)
    path = token_files.shared_dir(spark, "t")
    token_files.write_tokens(docs, token_files.tokenizer_text(), path, block_ids=5000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [i + [0] for i in library_ids([t or "" for _, t, _ in order])]
    start, want = 0, []
    for (d, _, _), i in zip(order, ids, strict=True):
        want.append((d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    got = collected(token_files.read_documents(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=key)
    back = defaultdict(list)
    for r in token_files.read_tokens(spark, path).collect():
        back[r["doc_id"]].append(r["ids"])
    for (d, _, _), i in zip(order, ids, strict=True):
        assert i in back[d]


# mixing


def brute_targets(sizes, weights, total, most=2.0):
    """Shares of ``total`` by weight; what exceeds ``most`` times a size is shared anew by weight among the others, until none is above."""
    target, full = [0.0] * len(sizes), [s == 0 for s in sizes]
    left = total
    while not all(full):
        weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        share = {i: left * weights[i] / weight for i, f in enumerate(full) if not f}
        over = [i for i, x in share.items() if x > most * sizes[i]]
        if not over:
            for i, x in share.items():
                target[i] = x
            break
        for i in over:
            target[i], full[i] = most * sizes[i], True
            left -= most * sizes[i]
    return target


def test_capped_targets():
    assert brute_targets([100, 100], [1, 1], 300, 2.0) == [150, 150]
    assert brute_targets([100, 10, 100], [3, 1, 2], 315, 2.0) == pytest.approx([177, 20, 118])
    assert brute_targets([0, 10], [1, 1], 15, 2.0) == [0, 15]
    assert brute_targets([], [], 0, 2.0) == []


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = mixing.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert n < 1000 or (p != mixing.permute(np.arange(n), n, 6)).any()


def test_mixing(spark, sf_dir):
    rows = EDGES + documents(sf_dir, spark)
    docs = with_clashes(spark, rows)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(split(t))) for d, t, _ in rows)
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = {s: sum(len(split(t)) for _, t, x in rows if x == s) for s in names}
    targets = brute_targets([sizes[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for r in got:
        by[r["source_size"], r["target"]] = by.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert {k: pytest.approx(v) for k, v in by} == {sizes[s]: t for s, t in zip(names, targets, strict=True)}
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 2 * mixing.BLOCK_WORDS


def test_shards_are_multinomial_draws(spark):
    """Shards have a fixed size; a source's count in a shard has the draws' mean and variance; totals are met."""
    targets = spark.createDataFrame([("a", 640_000, 960_000.0, 0), ("b", 640_000, 320_000.0, 1), ("c", 64, 128.0, 2)], "source string, source_size long, target double, place long")
    counts = defaultdict(dict)
    for r in mixing.shard_counts(targets, shard_slots=100).collect():
        counts[r["shard"]][r["place"]] = r["n"]
    sizes = [sum(c.values()) for _, c in sorted(counts.items())]
    assert set(sizes[:-1]) == {100} and sum(sizes) == 15_000 + 5_000 + 2
    assert [sum(c.get(p, 0) for c in counts.values()) for p in range(3)] == [15_000, 5_000, 2]
    b = np.array([c.get(1, 0) for s, c in counts.items() if s < 200])
    assert abs(b.mean() - 25) < 0.5 and 12 < b.var() < 27  # 100 * 1/4 * 3/4 = 18.75
    turns = Counter((r["place"], r["block"]) for r in mixing.slots(targets, shard_slots=100).collect())
    assert {p: max(n for (q, _), n in turns.items() if q == p) for p in range(3)} == {0: 2, 1: 1, 2: 2}


def test_mixed_documents_have_the_taken_words(spark, sf_dir):
    rows = EDGES + documents(sf_dir, spark)
    docs = with_clashes(spark, rows)
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(split(r["text"]))
        assert r["n_chars"] == len(r["text"])
    # Documents may be placed otherwise (the row's hash tells ties apart), so sums agree by source.
    assert sum(words.values()) == pytest.approx(sum(taken.values()), abs=2 * mixing.BLOCK_WORDS * 20)
    assert {d for d, n in words.items() if n} <= {d for d, _, _ in rows}
    sharded = mixing.mixed_documents(docs, shard_column="shard")
    assert sharded.columns == [*docs.columns, "shard"] and sharded.where("shard is null").isEmpty()


# all


@pytest.mark.parametrize("run", [quality.keep_good, substring_dedup.dedup_substrings, simhash.near_duplicates, simhash.keep_one, token_files.tokenize_documents, mixing.mix_sources, mixing.mixed_documents])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], CLASH)).count() == 0
