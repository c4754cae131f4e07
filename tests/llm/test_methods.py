"""The methods of the training-data operators against enumeration, brute force and odd tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import components, decontam, html_text, line_dedup, packing, quality, repeats, simhash, token_counts, token_shards, toxicity
from folioforge.llm.common import materialise
from tests.llm.test_operators import corpus, groups, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["quality", "n_words", "n_lines", "dropped", "n_dropped", "kept", "_key", "_n", "_m", "_text", "h", "line", "root", "votes", "item_id", "n_chars"]


def odd_rows():
    return [(i, t, *[f"{i}-{c}" if k % 2 else None for k, c in enumerate(ODD)]) for i, t in corpus()]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), f"doc_id long, text string, {', '.join(f'`{c}` string' for c in ODD[:-1])}, n_chars string").drop("n_chars").repartition(3)


def test_stages_leave_other_columns_alone(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, prose(40, 4242))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(r[0], r[2:-1]) for r in odd_rows()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, str(tmp_path))
        assert out.columns == odd_docs.columns, name
        rows = out.collect()
        assert rows and {(r["doc_id"], tuple(r)[2:]) for r in rows} <= want, name
        assert stage(spark, odd_docs.where("false"), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs.where("false"), str(tmp_path)).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark, odd_docs):
    items = spark.createDataFrame([(1, prose(120, 0))], "item_id long, text string")
    out = decontam.decontaminate(odd_docs, items)
    gone = Counter(r["doc_id"] for r in odd_docs.collect()) - Counter(r["doc_id"] for r in out.collect())
    assert out.columns == odd_docs.columns and set(gone) == {0, 12}
    assert decontam.contaminated(odd_docs.where("false"), items).count() == 0


def test_size_classes_lose_nothing(spark):
    """Long documents that hold from 60 to 100 % of items of every size."""
    r, items, rows = random.Random(8), [], []
    for j in range(60):
        w = prose(r.randint(1, 200), 20000 + j).split()
        items.append((j, " ".join(w)))
        kept = list(w)
        for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.05]))):
            kept[r.randrange(len(kept))] = "other"
        rows.append((j, " ".join([prose(300, 30000 + j), *kept, prose(300, 40000 + j)])))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs, table).collect()}
    cut = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    want = set()
    for j, t in items:
        w = t.split()
        k = min(5, len(w))
        for i, d in rows:
            if len(cut(w, k) & cut(d.split(), k)) >= 0.8 * len(cut(w, k)):
                want.add((i, j))
    assert got == want and len(want) > 30


def test_marginals_match_enumeration():
    r = np.random.default_rng(4)
    for _ in range(20):
        sizes = r.integers(0, 7, 5)
        e, start, moves = r.normal(0, 2, sizes.sum()), r.normal(), r.normal(0, 1, 4)
        want, at = [], 0
        for n in sizes:
            own, at = e[at : at + n], at + n
            total, toxic = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=int(n)):
                score = sum(x * v for x, v in zip(y, own, strict=True)) + (start * y[0] if n else 0)
                score += sum(moves[2 * a + b] for a, b in zip(y, y[1:], strict=False))
                total += np.exp(score)
                toxic += np.exp(score) * np.array(y)
            want += list(toxic / total)
        assert np.allclose(toxicity.marginals(e, sizes, start, moves), want, atol=1e-9)


def test_training_takes_bounded_texts(spark):
    rows = [(1, "toxic words here " * 50)] * 3000 + [(i, prose(40, 50000 + i)) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, toxic int")
    drawn, _ = toxicity.training_sample(docs, labels, 20, 4000, "doc_id", "text", "toxic")
    got = drawn.collect()
    assert len({r["id"] for r in got}) == len(got) <= 20 and sum(len(r["text"].encode()) for r in got) <= 4000
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_expectation_maximisation_finds_the_accuracies(spark):
    r = random.Random(6)
    right, patterns = [0.95, 0.9, 0.8, 0.7, 0.6], Counter()
    truth = []
    for _ in range(20000):
        y = 1 if r.random() < 0.6 else -1
        cast = tuple(0 if r.random() < 0.2 else (y if r.random() < p else -y) for p in right)
        patterns[cast] += 1
        truth.append((y, cast))
    table = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
    prior, good, bad = quality.fit(table, 5)
    assert abs(prior - 0.6) < 0.03
    assert all(abs(g - p) < 0.04 and abs(b - (1 - p)) < 0.04 for p, g, b in zip(right, good, bad, strict=True))
    # one expression's rounds against plain ones
    q = {v: 1 / (1 + np.exp(-sum(v))) for v in patterns}
    for turn in range(31):
        if turn:
            q = {v: 1 / (1 + np.exp(-(np.log(m[0] / (1 - m[0])) + sum(
                np.log(a / b) if x == 1 else np.log((1 - a) / (1 - b)) if x == -1 else 0 for x, a, b in zip(v, m[1], m[2], strict=True)
            )))) for v in patterns}
        rate = lambda j, s: (sum(n * s(v) for v, n in patterns.items() if v[j] == 1) + 1) / (sum(n * s(v) for v, n in patterns.items() if v[j]) + 2)  # noqa: E731, B023
        m = (
            (sum(n * q[v] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + 2),
            [rate(j, lambda v: q[v]) for j in range(5)], [rate(j, lambda v: 1 - q[v]) for j in range(5)],
        )
    assert np.allclose([prior, *good, *bad], [m[0], *m[1], *m[2]], atol=1e-9)
    model = quality.posterior_of(F.col("votes"), prior, good, bad).alias("p")
    got = {tuple(x["votes"]): x["p"] for x in table.select("votes", model).collect()}
    assert sum((got[v] >= 0.5) == (y > 0) for y, v in truth) > 0.9 * len(truth)


def test_passages_of_over_fifty_words_are_counted(spark):
    shared = prose(60, 70000).split()
    texts = {
        1: " ".join([*prose(30, 70001).split(), *shared, *prose(20, 70002).split()]),
        2: " ".join([*prose(25, 70003).split(), *shared[:51], *prose(40, 70004).split()]),
        3: " ".join([*prose(25, 70005).split(), *shared[:50], *prose(40, 70006).split()]),
        4: prose(300, 70007), 5: None, 6: "",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_passage_words"] for r in repeats.remove_repeats(table, with_passages=True).collect()}
    assert got == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0, 6: 0}


def test_ends_and_rests_are_put_in_order():
    r = random.Random(9)
    group = np.array([r.randrange(3) for _ in range(60)])
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in group]
    order, common = repeats.suffix_order(group, strings, 10)
    ranked = [(group[i], strings[i]) for i in order]
    assert ranked == sorted(ranked)
    for (g, a), (h, b), n in zip(ranked, ranked[1:], common[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (min(10, same) if g == h else -1)


def test_line_recall_against_all_pairs(spark):
    """Lines of every length, edited by characters and words; all pairs are compared."""
    r, lines = random.Random(12), []
    for i in range(400):
        words = prose(r.choice([4, 6, 9, 14, 25, 60]), 80000 + i).split()
        lines.append(" ".join(words))
        copy = list(words)
        for _ in range(r.randint(0, max(1, len(words) // 9))):
            copy[r.randrange(len(copy))] = r.choice(["zz", copy[0], "yx"])
        text = list(" ".join(copy))
        for _ in range(r.randint(0, max(1, len(text) // 60))):
            text[r.randrange(len(text))] = r.choice("uvwxyz")
        lines.append("".join(text))
    lines = sorted(set(lines))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links = line_dedup.line_links(spark.createDataFrame(list(enumerate(lines)), "h long, line string"), 0.8)
    got = [(x["src"], x["dst"]) for x in links.collect()]
    of = groups(len(lines), got)
    joined = sum(of[i] == of[j] for i, j in near)
    print("joined", joined, "of", len(near))
    assert all((max(p), min(p)) in set(near) for p in got) and joined >= 0.98 * len(near) and len(near) > 100


def test_the_first_of_tied_lines_stays(spark):
    line = prose(12, 90000)
    table = spark.createDataFrame([(5, line), (3, f"{line}\n{line}"), (None, line), (3, f"own {line} other words\n{line}")], "doc_id long, text string")
    out = line_dedup.dedup_lines(table).collect()
    kept = [(r["doc_id"], n) for r in out for n in range(r["n_lines"]) if n not in r["dropped"] and r["text"]]
    assert {k for k, _ in kept} == {3} and sum(r["n_lines"] - r["n_dropped"] for r in out) <= 2


def test_a_digest_is_encoded_once_for_all_runs(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "cache"), [(i, prose(20, 91000 + i % 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a = token_counts.count_tokens(docs, BYTE, path).collect()
    files = len(spark.read.parquet(path).inputFiles())
    assert spark.read.parquet(path).count() == 5
    more = docs.unionByName(spark.createDataFrame([(99, prose(20, 91999))], "doc_id long, text string"))
    monkeypatch.setattr(token_counts.tokenize, "counter", None, raising=True)
    again = token_counts.count_tokens(docs, BYTE, path).collect()
    assert Counter(a) == Counter(again) and len(spark.read.parquet(path).inputFiles()) == files
    monkeypatch.undo()
    token_counts.count_tokens(more, BYTE, path).collect()
    token_counts.count_tokens(docs, WORD, path).collect()
    stored = Counter(r["tokenizer"] for r in spark.read.parquet(path).collect())
    assert sorted(stored.values()) == [5, 6]
    assert Counter(a) == Counter(token_counts.count_tokens(docs, BYTE, path).collect())


def test_orders_of_two_keys(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(30, 92000 + i)) for i in range(60)], "doc_id long, text string").repartition(2)
    orders = []
    for key in (1, 2, 1):
        manifest, places = token_shards.write_training_order(docs, WORD, str(tmp_path / f"{key}-{len(orders)}"), key=key, length=32, per_shard=16)
        files = [r["path"] for r in sorted(manifest.collect(), key=lambda r: r["shard"])]
        orders.append(np.concatenate([token_shards.read_records(p, length=32) for p in files]))
        assert sum(r["records"] for r in manifest.collect()) == len(orders[-1])
    whole = lambda x: sorted(map(tuple, x.tolist()))
    assert whole(orders[0]) == whole(orders[1]) and not np.array_equal(orders[0], orders[1]) and np.array_equal(orders[0], orders[2])


def page_of(parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_tag_paths_choose_without_names():
    """Pages whose elements are not named: the container is told by ratios alone."""
    r = random.Random(13)
    for i in range(40):
        body = [prose(r.randint(30, 80), 93000 + 20 * i + k) + ", and so on. It ends here." for k in range(r.randint(3, 9))]
        head = prose(5, 94000 + i)
        links = "".join(f"<li><i>{prose(1, 95000 + 20 * i + k)}</i></li>" for k in range(r.randint(4, 12)))
        end = f"<div><span>{prose(3, 96000 + i)}</span></div>"
        page = page_of([f"<ul>{links}</ul>", "<div><div>", f"<h1>{head}</h1>", *[f"<p>{x}</p>" for x in body], "</div></div>", end])
        assert html_text.main_text(page) == "\n".join([head, *body])
        flat = lambda e, *_: np.ones(len(e))
        old, html_text.path_ratios = html_text.path_ratios, flat
        try:
            assert html_text.main_text(page) != "\n".join([head, *body])
        finally:
            html_text.path_ratios = old


def test_pages_of_deep_elements_are_read(spark):
    n = 20000
    assert html_text.main_text("<div>" * n + "<p>deep text." + "</div>" * n) == "deep text."
    assert html_text.main_text("".join(f"<div>text {i}" for i in range(n))).count("\n") == n - 1
    assert html_text.main_text("<b>" * n + "<p>x." * n + "</i>" * n).count("x.") == n
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_main_text(none).count() == 0


def test_near_duplicate_recall(spark):
    """Word edits at a five-word similarity of 0.8 and above; fingerprints alone reach few."""
    r, rows, near = random.Random(14), [], 0
    sets = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    for i in range(150):
        a = prose(r.randint(60, 300), 97000 + i).split()
        b = list(a)
        for _ in range(max(1, round(len(a) * r.uniform(0.002, 0.02)))):
            b[r.randrange(len(b))] = "edited"
        if len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b)):
            rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
            near += 1
    roots = {x["k"]: x["root"] for x in simhash.near_duplicate_roots(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    caught = sum(roots[k] == roots[k + 1] for k in roots if k % 2 == 0)
    assert near > 100 and caught >= 0.99 * near and len(set(roots.values())) >= near


def test_near_copies_take_about_one_link_a_line(spark):
    """Copies of one line that lie in many buckets: components need no link from each bucket."""
    r, base, lines = random.Random(17), prose(60, 95000).split(), set()
    while len(lines) < 150:
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(len(copy))] = r.choice(["zz", "yx", "qv"])
        lines.add(" ".join(copy))
    table = spark.createDataFrame(list(enumerate(sorted(lines))), "h long, line string")
    got = [(x["src"], x["dst"]) for x in line_dedup.line_links(table, 0.8).collect()]
    assert len(set(groups(150, got))) == 1 and len(got) <= 2 * 150


def test_a_pair_is_met_in_one_bucket(spark):
    """Lines of three buckets that are not in one component."""
    lines = [prose(14, 96000) + f" end {i:03}" for i in range(12)]
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    buckets = spark.createDataFrame([(b, h) for b in (7, 3, 5) for h in range(12) if h != b], "bucket long, h long")
    none = spark.createDataFrame([], "node long, root long")
    got = [(x["src"], x["dst"]) for x in line_dedup.open_pairs(buckets, line_dedup.bitmaps(texts), none, 0.8).collect()]
    assert sorted(got) == [(i, j) for i in range(12) for j in range(i + 1, 12)]


def test_shuffles_go_with_their_query(spark):
    files = lambda: str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(","))
    held = lambda: len(re.findall(r"shuffle_\d+_\d+_\d+\.data", files()))
    spark.range(10**5).groupBy((F.col("id") % 999).alias("k")).count().write.format("noop").mode("overwrite").save()
    before = held()
    assert before > 0
    kept = materialise(spark.range(10**5).groupBy((F.col("id") % 997).alias("k")).count(), "kept")
    assert held() <= before
    assert kept.count() == 997


def test_components_on_the_driver(spark):
    r = random.Random(23)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(i + 1, i) for i in range(1000, 3000)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    ends = {x for p in pairs for x in p if p[0] != p[1]}
    want = groups(3001, pairs)
    for local in (0, 300, 10**5):
        found = {x["node"]: x["root"] for x in components.connected_components(edges, local=local).collect()}
        assert set(found) == ends
        assert len({(found[x], want[x]) for x in ends}) == len(set(found.values())) == len({want[x] for x in ends})


def test_blank_lines_have_no_word(spark):
    lines = ["", " \t\n\x0b\f\r ", "\r\r", " a ", " ", " ", "\x00", None, "x" * 5000 + " "]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = {x["i"] for x in table.where(line_dedup._has_word(F.col("x"))).collect()}
    assert got == {3, 4, 5, 6, 8}
