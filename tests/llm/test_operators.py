"""The training-data operators against brute-force versions and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm import (
    components, decontam, html_text, line_dedup, packing, quality, repeats, simhash, token_counts, token_shards, tokenize, toxicity,
)

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
draw = random.Random(7)
WORDS = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(120, i) for i in range(12)]
    texts = [*base, base[0], base[1], base[2].replace(base[2].split()[5], "changed", 1), base[3] + " tail words", base[4][:600] + prose(30, 99)]
    texts += [prose(40, 50) + "\n" + base[5][100:650] + "\n" + prose(30, 51), prose(3, 60), "one", "", "   \n ", None, "a" * 3000, "x " * 900]
    return [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (None, base[6]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, repeats, a long text, ties, and columns with names that the
    operators use themselves."""
    rows = [(i, t, "en", 1, 2, "x", 0.5) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h int, n_words int, dropped string, score double").repartition(3)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash_matches_brute_force(docs):
    rows = corpus()
    prints = [brute_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    of = groups(len(rows), near)
    least = defaultdict(list)
    for (i, _), g in zip(rows, of, strict=True):
        least[g] += [i] if i is not None else []
    want = Counter((i, p, min(least[g], default=None)) for (i, _), p, g in zip(rows, prints, of, strict=True))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == want


@pytest.mark.parametrize("n", [10, 10**7, 10**9])
def test_every_table_choice_links_all_pairs(n):
    r = np.random.default_rng(n)
    prints = np.unique(np.concatenate([x ^ (np.uint64(1) << r.integers(0, 64, 6, np.uint64)) for x in r.integers(0, 2**63, 60).astype(np.uint64)]))
    linked = []
    for blocks in simhash.block_tables(n, 4):
        roots = simhash.link_forest(prints, blocks, 4)
        linked += [(i, int(j)) for i, j in enumerate(roots)]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    assert groups(len(prints), linked) == groups(len(prints), want)


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (900, 901), (901, 900), (None, 5)]
    found = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    of = {r["node"]: r["root"] for r in found}
    assert len({of[i] for i in range(41)}) == 1 and len({of[200 + i] for i in range(30)} | {of[100]}) == 1
    assert of[900] == of[901] and len(set(of.values())) == 3


def test_quality_measures_match_brute_force(docs):
    got = quality.score_quality(docs, carry=["doc_id", "text"]).collect()
    assert len(got) == len(corpus())
    for r in got:
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_lines_keep_one_of_each_component(docs, spark):
    lines = [prose(20, 300 + i) for i in range(30)]
    near = [x + " end" for x in lines[:10]] + [x.upper() for x in lines[10:15]]
    table = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(near) + "\n\nown line here"), (2, "\n".join(near) + "\n\nown line here")], "doc_id long, text string")
    out = {}
    for r in line_dedup.dedup_lines(table).collect():
        out.setdefault(r["doc_id"], []).append((r["n_lines"], r["n_dropped"], r["text"]))
    assert out[1] == [(30, 0, "\n".join(lines))]
    assert sorted(out[2]) == [(16, 15, "\nown line here"), (16, 16, "")]
    odd = line_dedup.dedup_lines(docs)
    assert odd.count() == len(corpus()) and odd.where("text is null").count() == 2


def test_every_candidate_of_a_bucket_is_compared(spark, monkeypatch):
    """Near copies part from each other in every other MinHash; leaders match neither."""
    lines = [prose(14, 3000 + i) for i in range(12)]
    lines += [x + " e" for x in lines[1:]]
    lines += [lines[1] + " e later on here"]  # matches a matched line only
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = groups(len(lines), near)
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    rows = [(1, i, [1000 * i + b for b in range(10)]) for i in range(len(lines))]
    buckets = spark.createDataFrame(rows, "bucket long, h long, rows array<int>")
    for block in (512, 3):
        monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
        got = [(r["src"], r["dst"]) for r in line_dedup.verified_links(buckets, texts, 0.8).collect()]
        assert set(got) <= {(j, i) for i, j in near} and groups(len(lines), got) == want


def test_lines_of_any_length_share_bands(spark):
    """Lines of 80 characters and their copies without the last one."""
    lines = [prose(30, 4000 + i)[:79] + "z" for i in range(20)]
    table = spark.createDataFrame([(k, x) for i, x in enumerate(lines) for k, x in ((i, x), (100 + i, x[:-1]))], "h long, line string")
    met = {}
    for r in line_dedup.candidate_buckets(table).collect():
        met.setdefault(r["bucket"], set()).add(r["h"])
    assert all(any({i, 100 + i} <= x for x in met.values()) for i in range(20))


def test_band_recall_at_the_threshold(spark):
    """Scattered one-character edits of long lines, at an exact similarity of 0.80 to 0.84."""
    r, rows, sets = random.Random(11), [], lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    while len(rows) < 1000:
        a = list(prose(r.randint(16, 90), 5000 + r.randrange(10**6))[:500])
        b = list(a)
        for _ in range(max(1, round(len(a) * r.uniform(0.018, 0.024)))):
            b[r.randrange(len(b))] = r.choice("qrstuvwxyz")
        a, b = "".join(a), "".join(b)
        if 0.8 <= len(sets(a) & sets(b)) / len(sets(a) | sets(b)) < 0.84:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    shared = line_dedup.candidate_buckets(spark.createDataFrame(rows, "h long, line string")).groupBy("bucket").agg(F.collect_list("h").alias("h"))
    met = [set(x["h"]) for x in shared.collect()]
    caught = sum(any({i, i + 1} <= x for x in met) for i in range(0, len(rows), 2))
    print("caught", caught, "of", len(rows) // 2)
    assert caught >= 0.99 * len(rows) / 2


def test_line_similarity_is_exact(spark):
    r, lines = random.Random(5), ["abc", "abcd", "abcde", "x" * 300, "ab " * 90, "宇宙の文字列" * 9, "a\rb  c\u2028d e f g"]
    for i in range(60):
        words = prose(r.choice([3, 8, 30, 90]), 900 + i).split()
        lines.append(" ".join(words))
        for _ in range(r.choice([1, 1, 2, 6, 30])):
            words[r.randrange(len(words))] = r.choice(["new", words[0], "wörter", ""])
        lines.append(" ".join(words).strip() or "none")
        lines.append(" ".join(reversed(words)).strip() or "none")
    pairs = list(zip(lines, lines[1:], strict=False)) + [(a, b) for a in lines[:7] for b in lines[:12]]
    sets = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} or {x}
    table = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a string, b string")
    same = (line_dedup.jaccard(F.col("a"), F.col("b")) >= 0.8).alias("same")
    got = table.select("a", "b", same).collect()
    for x in got:
        a, b = sets(x["a"]), sets(x["b"])
        assert x["same"] == (len(a & b) / len(a | b) >= 0.8)
    assert 20 < sum(x["same"] for x in got) < len(got) - 20


def test_repeats_match_brute_force(docs):
    rows = corpus()
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    want = Counter()
    for (k, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        want[k, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect())
    assert got == want


def test_repeats_of_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "IN_TASK", 5)
    shared = prose(90, 1)[:450]
    table = spark.createDataFrame([(i, prose(40, 500 + i) + shared + prose(40, 700 + i)) for i in range(20)], "doc_id long, text string")
    assert all(450 <= r["n_removed"] < 470 and r["n_spans"] == 1 for r in repeats.remove_repeats(table).collect())


def test_packing_round_trip(docs):
    exact = Tokenizer.from_file(WORD)
    want = Counter(tuple([*exact.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in corpus())
    placed = packing.pack_documents(docs, WORD, capacity=256, with_ids=True)
    rows = placed.collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] <= 256 and r["start"] == 256 * r["piece"] for r in rows)
    ids = Counter(np.frombuffer(r["ids"], "<u4").tolist().__str__() for r in rows)
    cut = Counter(str(list(x[i : i + 256])) for x, n in want.items() for _ in range(n) for i in range(0, len(x), 256))
    assert ids == cut
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 256
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(placed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in bins.items()}


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(30):
        items = sorted((r.randint(1, 50) for _ in range(r.randint(1, 300))), reverse=True)
        rooms = []
        for x in items:
            fit = [i for i, room in enumerate(rooms) if room >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(50 - x)
        counts, used = Counter(items), defaultdict(int)
        runs = sorted(packing.best_fit_plan(dict(counts), 50))
        for (n, first, start, _), after in zip(runs, [*runs[1:], (0, 0, 0, 0)], strict=True):
            for k in range((after[1] if after[0] == n else counts[n]) - first):
                used[start + k] += n
        assert sorted(50 - x for x in used.values()) == sorted(rooms)


def test_tokenisers_agree_with_the_library():
    a, b = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    words, spaced, counts = tokenize.WordIds(WORD), tokenize.SpacedIds(BYTE), tokenize.SpacedCounts(BYTE)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "1", "23", ".", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "́", " ", "日本", "\x1c", "😀", "\r\n", "the"]
    for _ in range(3000):
        s = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert np.frombuffer(words(s), "<u4").tolist() == a.encode(s, add_special_tokens=False).ids
        want = b.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(spaced(s), "<u4").tolist() == want and counts(s) == len(want)


def test_counts_come_from_the_cache(docs, spark, tmp_path):
    path = str(tmp_path / "cache")
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTE, path).collect())
    exact = Tokenizer.from_file(BYTE)
    n = lambda t: len(exact.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((i, len((t or "").encode()), n(t), n(t) > 512) for i, t in corpus())
    stored = spark.read.parquet(path).count()
    assert stored == len({t or "" for _, t in corpus()})
    token_counts.count_tokens(docs, BYTE, path).collect()
    assert spark.read.parquet(path).count() == stored


def test_shards_read_back(docs, tmp_path):
    manifest, places = token_shards.write_training_order(docs, WORD, str(tmp_path), length=64, per_shard=8)
    paths = {r["shard"]: r["path"] for r in manifest.collect()}
    exact, data = Tokenizer.from_file(WORD), {k: token_shards.read_records(p, length=64) for k, p in paths.items()}
    got, rows = Counter(), places.collect()
    for r in rows:
        got[tuple(data[r["shard"]][r["record"]][r["offset"] : r["offset"] + r["length"]].tolist())] += 1
    want = [[*exact.encode(t or "", add_special_tokens=False).ids, 49407] for _, t in corpus()]
    assert sum(len(k) * n for k, n in got.items()) == sum(map(len, want))
    assert Counter(x for k, n in got.items() for x in k * n) == Counter(x for w in want for x in w)
    assert sorted({r["slot"] for r in rows}) == list(range(len({r["slot"] for r in rows})))
    for n in (1, 2, 5, 1000):
        assert sorted(token_shards.permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_containment_matches_brute_force(docs, spark):
    items = [(1, prose(120, 0).upper()), (2, prose(30, 800)), (3, None), (4, "one"), (5, " ".join(prose(120, 7).split()[20:60]) + " and more unseen words here"), (6, "")]
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: re.findall(r"\w+", (t or "").lower())
    cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for j, t in items:
        w = plain(t)
        k = min(5, len(w))
        for i, d in corpus():
            hit = len(cut(w, k) & cut(plain(d), k)) if k else 0
            if hit and hit >= 0.8 * len(cut(w, k)):
                want.add((i, j, hit))
    assert got == want and {j for _, j, _ in got} >= {1, 4, 5}


def test_toxic_words_are_found_and_scored(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = prose(60, 1000 + i).split()
        if i % 4 == 0:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["vilest", "scumbag", "hateful"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (None, "vilest")]
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.score_toxicity(table, known, with_spans=True).collect()}
    held = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and len(out) == len(rows)
    found = {dict(rows)[0][s["start"] : s["start"] + s["length"]] for s in out[0]["spans"]}
    assert found and found <= {"vilest", "scumbag", "hateful"}
    assert out[1000]["score"] == out[1001]["score"] < 0.5
    none = toxicity.score_toxicity(table, known.where("false")).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)


def test_main_text_of_pages():
    body = "<h1>Title</h1><p><b>First  line.<br><p>Second &amp; third, with words.</p><p>Short.</p>"
    page = f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a href=/>Menu</a></nav><div class=\"ad\">Buy now, really.</div><article>{body}<aside>Side</aside></article><div id=comments><p>I disagree, strongly.</p></div><footer>&copy; me</footer></body></html>"
    assert html_text.main_text(page) == "Title\nFirst line.\nSecond & third, with words.\nShort."
    plain = "<html><body><div class='menu'>a b</div><div id=content><p>" + prose(40, 1) + ".</p><p>" + prose(30, 2) + ".</p></div><form>x</form></body></html>"
    assert html_text.main_text(plain) == prose(40, 1) + ".\n" + prose(30, 2) + "."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div") == ""


def test_main_text_of_several_parts():
    part = lambda w, n: "".join(f"<p>{' '.join([w] * 30)}, and so on. {i}</p>" for i in range(n))
    pages = [
        f"<div>{part('first', 17)}</div><div>{part('second', 3)}<p>short</p></div>",
        f"<main><article>{part('first', 17)}</article><section>{part('second', 3)}</section></main>",
    ]
    for page in pages:
        got = html_text.main_text(f"<body><nav>menu</nav>{page}</body>")
        assert got.count("first, and") == 17 and got.count("second, and") == 3 and "menu" not in got


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert simhash.simhash_components(none).count() == 0
    assert quality.score_quality(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0
    assert token_counts.count_tokens(none, BYTE).count() == 0
    assert token_shards.write_training_order(none, WORD)[1].count() == 0
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_main_text(pages).collect()] == ["", ""]
