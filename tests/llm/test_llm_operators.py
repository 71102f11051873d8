"""Every corpus operator against brute force on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import math
import os
import random
import sys
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus as C  # noqa: E402

from blockhist.llm import (decontaminate, graph, language, lines, minhash, mixing, pii, quality, queries, repeats,  # noqa: E402
                           suffixes, tokens, urls)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PAIRS = [(r[0], r[1]) for r in C.rows()]


@pytest.fixture(scope="module")
def docs(spark):
    return C.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], C.SCHEMA)


@pytest.fixture(scope="module")
def clash(spark):
    return C.documents(spark, clash=True)


# personal data

def test_pii_base_spans(docs):
    got = C.in_order((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.digest(docs).collect())
    want = []
    for doc, text in PAIRS:
        spans = C.base_spans(text)
        want.append((doc, hashlib.sha256(",".join(spans).encode()).hexdigest(), *[sum(s.startswith(k) for s in spans) for k in C.BASE]))
    assert got == C.in_order(want)


def test_pii_hard_texts(spark):
    texts = ["a@b.c_x@d.e a@b.c@d.e", "1.2.3.4.5.6.7.8 000.01.255.0 256.1.1.1", "4111-1111 1111-1111 2 4111111111111111",
             "+1.2.3.4567890123 +12 +1 (2) 3-4.5 6789 0", "1" * 5000 + " x@y.zz" * 700, "@@@..@a.b", "🙂a@b.cc🙂 +49 30 1234567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in pii.digest(df).collect()}
    assert got == {i: hashlib.sha256(",".join(C.base_spans(t)).encode()).hexdigest() for i, t in enumerate(texts)}


def test_pii_checksum_and_context_add_kinds(docs):
    spans = {r.doc_id: r.spans for r in pii.digest(docs).collect() if r.doc_id is not None}
    assert "iban:5:32" in spans[15] and "ssn:41:52" in spans[15]
    assert "iban" not in spans[13]


def test_pii_masking_keeps_rows_and_columns(clash):
    out = pii.redact_pii(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert len(rows) == len(PAIRS)
    assert not any(C.base_spans(r.text) for r in rows)
    text = next(r.text for r in rows if r.doc_id == 13)
    assert text == "mail [EMAIL] or [PHONE], [CARD] [IP] 300.1.1.1"
    assert next(r.n_chars for r in rows if r.doc_id == 13) == len(text)
    assert {r.text for r in rows if r.doc_id in (4, 5)} == {None, ""}


def test_pii_masking_goes_on_until_nothing_is_left(spark):
    texts = ["+1 555 123 4567 (4111111111111111 10.0.0.1", "10.0.0.1", "plain", None]
    out = pii.redact_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {0: "[PHONE] ([CARD] [IP]", 1: "[IP]", 2: "plain", 3: None} and len(out) == 4


# suffix arrays

def test_suffix_array():
    rng = random.Random(3)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4, 90])) for _ in range(rng.randint(0, 60))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def repeated(spark):
    rng = random.Random(8)

    def some(n):
        return "".join(rng.choice("abcde é\n") for _ in range(n))
    passages = [some(rng.randint(300, 900)) for _ in range(5)]
    out = []
    for i in range(60):
        text = "".join(rng.choice([some(rng.randint(0, 300)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 200):]])
                       for _ in range(rng.randint(0, 5)))
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        out.append((i, text))
    return out + [(100, "a" * 3000), (101, "ab" * 900), (102, "x" * 399), (103, "x" * 400), *PAIRS]


@pytest.mark.parametrize("bucket", [2000, 3])
def test_repeats(spark, repeated, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    df = spark.createDataFrame(repeated, "doc_id long, text string")
    assert C.in_order(repeats.digest(df).collect()) == C.in_order(C.repeats(repeated, 400))


# near-duplicates

def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert C.in_order(got) == C.in_order(C.near_components(PAIRS))


def near_family():
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    out = [(1000 + i, " ".join(words)) for i in range(6)]
    for i in range(140):
        mine = list(words)
        for _ in range(rng.randint(0, 7)):
            mine[rng.randrange(len(mine))] = f"x{rng.randint(0, 99)}"
        out.append((i, " ".join(mine)))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_of_one_family(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert C.in_order(got) == C.in_order(C.near_components(rows))


def test_estimate_is_corrected_for_chance():
    assert abs(minhash.estimate(minhash.HASHES) - 1) < 1e-9
    assert abs(minhash.estimate(minhash.HASHES / 16)) < 1e-9
    assert minhash.least_matches(85) < minhash.HASHES * 0.859


def test_one_of_each_group_stays(clash):
    out = minhash.drop_near_duplicates(clash)
    assert out.columns == clash.columns
    got = C.in_order((r.doc_id, r.text) for r in out.collect())
    assert [d for d, t in got if d in (1, 2, 3)] == [1]  # and neither the row with base and no id
    assert sum(d is None for d, _ in got) == 1
    assert {4, 5, 6, 7} <= {d for d, _ in got} and 8 not in {d for d, _ in got}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (300, 300), (7, 500)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 500: 0, 100: 100, 200: 100, 300: 300}


# quality

def test_quality_base(docs):
    got = C.in_order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                     for r in quality.score_quality(docs).collect())
    assert got == C.in_order((d, *C.quality_base(t)) for d, t in PAIRS)


def test_quality_base_on_text(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c#", "d\n", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality.score_quality(df).collect()}
    assert got == {i: C.quality_base(t) for i, t in enumerate(texts)}


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(1)
    true, patterns = [0.95, 0.9, 0.8, 0.7, 0.6], {}
    for _ in range(20000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in true)
        patterns[votes] = patterns.get(votes, 0) + 1
    prior, right = quality.fit(patterns)
    assert abs(prior - 0.7) < 0.05
    assert all(abs(a - b) < 0.06 for pair, b in zip(right, true) for a in pair)
    assert quality.fit({}) == (0.5, [])


def test_quality_agrees_with_labels(spark):
    scored = quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = {r.doc_id: r for r in scored.collect()}
    good = [judged[d].kept for d, q in labels.items() if q == 1 and not judged[d].base_failed]
    bad = [judged[d].kept for d, q in labels.items() if q == 0]
    assert good and sum(good) >= 0.99 * len(good)
    assert bad and sum(bad) <= 0.1 * len(bad)


# URLs

@pytest.mark.parametrize("per_shard,limit", [(10 ** 6, 1 << 20), (50, 1 << 20), (50, 0)])
def test_cascade_is_exact(spark, per_shard, limit):
    keys = [f"host{i}.example" for i in range(3000)]
    listed = {k for i, k in enumerate(keys) if i % 7 == 0}
    universe = spark.createDataFrame([(k,) for k in keys] + [(keys[0],), (None,)], "host string")
    cascade = urls.build_cascade(spark.createDataFrame([(k,) for k in sorted(listed)] * 2, "host string"), universe, per_shard, limit)
    got = cascade.test(universe.withColumn("listed", F.lit(1)), "host")
    assert got.columns == ["host", "listed", "listed_"]
    rows = got.collect()
    assert len(rows) == 3002
    assert {r.host for r in rows if r.listed_} == listed


def test_no_group_of_a_cascade_holds_a_whole_shard(spark, monkeypatch):
    """One shard whose filter is not broadcast: its keys and rows meet it in groups of bounded size."""
    keys = [f"host{i}.example" for i in range(4000)]
    listed = keys[::5]
    sizes = spark.sparkContext.accumulator(0)
    real = urls._holds

    def counted(h1, *rest):
        if len(h1) > 150:
            sizes.add(1)
        return real(h1, *rest)
    monkeypatch.setattr(urls, "_holds", counted)
    universe = spark.createDataFrame([(k,) for k in keys] + [(keys[0],)] * 2000, "host string")
    cascade = urls.build_cascade(spark.createDataFrame([(k,) for k in listed], "host string"), universe, 10 ** 6, 0, 100)
    assert cascade.shards == 1 and not cascade.small
    rows = cascade.test(universe, "host", rows_per_group=100).collect()
    assert len(rows) == 6000 and {r.host for r in rows if r.listed} == set(listed)
    assert sizes.value == 0


def test_empty_cascade(spark):
    none = spark.createDataFrame([], "host string")
    some = spark.createDataFrame([("a",), (None,)], "host string")
    assert not any(r.listed for r in urls.build_cascade(none, some).test(some, "host").collect())
    assert urls.build_cascade(some, none).test(some, "host").where("listed").count() == 1
    assert urls.build_cascade(none, none).test(none, "host").count() == 0


def test_url_rules(spark):
    cases = {"http://a.example.net/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://EXAMPLE.net/fr": ("example.net", "/fr", "net/", "block"),
             "http://net": ("net", "", None, "allow"), "x://example.com/de/?q": ("example.com", "/de/", "example.com/de/", "block"),
             "//no.scheme/": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d#e": ("b:", "//c/d", None, "allow"),
             "http://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"), "http://spam-x.example.com/en?a=://b": ("spam-x.example.com", "/en", None, "block"),
             "http://notexample.net?x/": ("notexample.net", "", None, "allow"), "": ("", "", None, "allow")}
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(cases)], "page_id long, url string, host string")
    hosts = pages.select(urls.host_of(F.col("url")).alias("h"))
    out = urls.judge_urls(pages, urls.build_cascade(hosts.where(F.col("h").rlike(urls.LISTED_LABELS)), hosts), urls.RULES)
    assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]
    assert {r.url: (r.host_, r.path, r.rule, r.verdict) for r in out.collect()} == cases


# lines

def test_line_dedup(docs):
    got = {(r.doc_id, r.n_removed): r for r in lines.digest(docs).collect()}
    text = dict(PAIRS)
    passage = text[10].split("\n")[1]
    assert (9, 1) in got and (10, 1) in got
    first = got[9, 1].spans.split(":")
    assert text[9][int(first[0]):int(first[1])] == passage and int(first[0]) > 0
    assert (3, 1) in got and (1, 0) in got  # the same line in capitals


def test_lines_are_cut(clash):
    clash = clash.withColumn("repeats", F.lit("kept")).withColumn("gone_doc", F.lit(1)).withColumn("unit", F.lit(1))
    made = lines.remove_repeats(clash)
    assert made.columns == [*clash.columns, "repeats_"] and made.where("repeats <> 'kept'").count() == 0
    out = {r.doc_id: r for r in made.collect() if r.doc_id}
    assert out[10].text == "intro words first\nend of it"
    assert out[10].repeats_[0].start == len("intro words first\n")
    assert out[4].text is None and out[5].text == ""


def brute_units(rows):
    """Per row (doc_id, n_lines, n_removed, chars_removed, spans, n_passages, passages), all lines compared."""
    every = []
    for r, (doc, text) in enumerate(rows):
        at = 0
        for line in (text or "").split("\n") if text is not None else []:
            words = C.blank_words(line)
            if words:
                every.append((b" ".join(words), (doc is None, doc or 0, hashlib.md5(text.encode()).digest(), at), r, at, at + len(line), len(words)))
            at += len(line) + 1
    first = {}
    for key, rank, *_ in every:
        first[key] = min(first.get(key, rank), rank)
    out = []
    for r, (doc, text) in enumerate(rows):
        mine = [(first[k] != rank, a, b, n) for k, rank, q, a, b, n in every if q == r]
        gone = [m for m in mine if m[0]]
        runs, run = [], []
        for m in [*mine, (False, 0, 0, 0)]:
            if m[0]:
                run.append(m)
            elif run:
                if sum(x[3] for x in run) > 50:
                    runs.append((run[0][1], run[-1][2]))
                run = []
        out.append((doc, len(mine), len(gone), sum(b - a for _, a, b, _ in gone), ",".join(f"{a}:{b}" for _, a, b, _ in gone),
                    len(runs), ",".join(f"{a}:{b}" for a, b in runs)))
    return out


def test_lines_against_brute_force(spark, docs):
    rnd = random.Random(8)
    pool = ["", " ", "\t \r", "A line  of words", "a LINE of\tWords ", "é Ü 漢字 🙂", "x " * 30, "one"] + [f"own {i} " * rnd.randint(1, 12) for i in range(20)]
    rows = [(rnd.choice([None, *range(30)]), None if rnd.random() < .05 else "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for _ in range(80)]
    rows += rows[:6] + [(99, "\n".join(pool * 60)), (98, "z" * 120_000 + "\none")]
    got = lines.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert C.in_order(got) == C.in_order(brute_units(rows))
    assert any(r.n_passages for r in got)
    assert C.in_order(lines.digest(docs).collect()) == C.in_order(brute_units(PAIRS))


def test_short_lines_are_cut(spark):
    texts = ["Menu\n\nHome\none of a kind", "other words\n menu \n\n\nhome", None, "", "\n \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in lines.remove_repeats(docs).collect()}
    assert [out[i].text for i in range(5)] == [texts[0], "other words\n\n", None, "", "\n \n"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.spans) for r in lines.digest(docs).collect()}
    assert got == {0: (3, 0, ""), 1: (3, 2, "12:18,21:25"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (0, 0, "")}
    assert [r.text for r in lines.remove_repeats(docs, min_words=2).orderBy("doc_id").collect()] == texts


# tokens

def test_token_counts(docs, clash):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(queries.VOCABULARY)
    vocabulary = tokens.read_vocabulary(queries.VOCABULARY)
    got = C.in_order((r.doc_id, r.tokens.n_bytes, r.tokens.n_tokens) for r in tokens.count_tokens(docs, vocabulary).collect())
    assert got == C.in_order((d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t in PAIRS)
    assert tokens.count_tokens(clash, vocabulary).columns == [*clash.columns, "tokens_"]


def test_merging_against_the_library():
    from tokenizers import Tokenizer
    own, counter = Tokenizer.from_file(queries.VOCABULARY), tokens.Counter(tokens.read_vocabulary(queries.VOCABULARY))
    rng = random.Random(6)
    parts = ["<|endoftext|>", " ", "\n\n", "  ", "'s", "'LL", "abc", "Zürich", "12345", "!!", "　", "漢字", "\t", "é", "🙂", "\x85", "x" * 90, "<|endof"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert counter.count(text) == len(own.encode(text, add_special_tokens=False).ids), text


# language

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = language.identify(docs, language.train(docs))
    rows = judged.where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(rows) > 20
    assert sum(r.language.lang == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.language.score <= 1 for r in rows)


def test_language_of_awkward_texts(docs, clash, empty):
    model = language.train(docs)
    assert model["langs"] == ["de", "en", "es", "fr"]
    out = language.identify(clash, model)
    assert out.columns == [*clash.columns, "language_"]
    for r in out.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.language_.lang == "und") == (not lettered) and (lettered or r.language_.score == 0)
    nothing = language.train(empty)
    assert {r.language.lang for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_language_does_not_depend_on_what_tasks_hold(spark):
    rows = [(4 * i, t, x) for i, (t, x) in enumerate([("alpha beta beta gamma", "xx"), ("delta epsilon delta beta", "yy"), ("zeta", "yy")] * 4)]
    rows += [(None, t, None) for t in ("gamma", "zeta", "gamma gamma", "gammb unseen", "zeta Zeta delta", "zeta", "ŋŋ", "", None, "7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = [C.in_order((r.doc_id, r.text, r.language.lang, r.language.score) for r in language.identify(docs, m).collect())
              for m in (language.train(docs), language.train(docs, max_words=1, max_grams=2))]
    assert judged[0] == judged[1]
    of = {t: x for d, t, x, _ in judged[1] if d is None}
    assert (of["gamma"], of["zeta"], of["gamma gamma"], of[""], of[None], of["7"]) == ("xx", "yy", "xx", "und", "und", "und")


def test_language_ignores_held_out_and_unlabelled(spark):
    ids = spark.range(60).select("id", language.held_out(F.col("id")).alias("out")).collect()
    rows = [(r.id, "zzz yyy" if r.out else "aaa bbb", "xx" if r.out else "yy") for r in ids] + [(1000, "qqq", None), (None, "rrr", "ww")]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["langs"] == ["yy"]


# mixing

def test_apportionment_takes_the_highest_quotients():
    rng = random.Random(9)
    for _ in range(300):
        votes = [rng.choice([0.0, rng.uniform(0, 100)]) for _ in range(rng.randint(1, 6))]
        caps = [rng.choice([0, 1, 5, 100]) for _ in votes]
        seats, block = rng.randint(0, 40), rng.choice([1.0, 4.0, 20.0])
        taken = [0] * len(votes)
        for _ in range(min(seats, sum(caps))):
            i = max((i for i in range(len(votes)) if taken[i] < caps[i]), key=lambda i: (votes[i] / (2 * taken[i] + 1), -i))
            taken[i] += 1
        got = mixing.apportion(votes, caps, seats, block)
        assert sum(got) == sum(taken)
        quotients = sorted((v / (2 * j + 1) for v, n in zip(votes, taken) for j in range(n)), reverse=True)
        mine = sorted((v / (2 * j + 1) for v, n in zip(votes, got) for j in range(n)), reverse=True)
        assert all(math.isclose(a, b) for a, b in zip(quotients, mine))


def test_targets_stop_at_twice_the_size():
    assert C.targets([100, 100, 100], [5, 2, 1], Fraction(3, 2), 2) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert C.targets([10, 1000], [5, 2], Fraction(3, 2), 2) == [20, 1495]
    assert C.targets([0, 0], [5, 2], Fraction(3, 2), 2) == [0, 0]


def test_targets_of_many_sources(spark):
    rnd = random.Random(6)
    for n in (1, 2, 3, 40, 400):
        sizes = {f"s{i:04d}": rnd.choice([0, 1, 10, 1000, rnd.randrange(10 ** 7)]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), Fraction(3, 2), 2).collect()}
        want = C.targets([sizes[s] for s in sorted(sizes)], [(5, 2, 1)[i % 3] for i in range(n)], Fraction(3, 2), 2)
        assert [got[s] for s in sorted(sizes)] == pytest.approx([float(x) for x in want], rel=1e-12)


def test_rows_of_one_id_and_size_are_spread(spark):
    """Texts of one null id and one size: shards hold about as many rows as they should, reruns agree."""
    rows = [(None, f"word{i} of seven words in this text", "a") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df, rows_per_shard=100).select("text", "mix.taken")
    cells = mixed.collect()
    assert sum(r.taken for r in cells) == pytest.approx(1.5 * 7 * 1200, rel=.01)
    again = mixing.mix_sources(df.repartition(7), rows_per_shard=100).select("text", "mix.taken").collect()
    assert C.in_order(again) == C.in_order(cells)


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sources(docs, rows_per_shard=60).select("doc_id", "source", "text", "mix.*").collect()
    assert len(rows) == docs.count()
    taken, goal, sizes = {}, {}, {}
    for r in rows:
        assert r.size == len(C.blank_words(r.text)) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        goal[r.source] = r.target
    names = sorted(sizes)
    want = C.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2), 2)
    assert all(math.isclose(goal[s], w) for s, w in zip(names, want))
    assert all(abs(taken[s] - goal[s]) <= 40 for s in names)
    again = mixing.mix_sources(docs.repartition(7), rows_per_shard=60).select("doc_id", "mix.taken").collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted(tuple(r) for r in again)


def test_mix_of_awkward_rows(docs, clash, empty):
    out = mixing.mix_sources(clash)
    assert out.columns == [*clash.columns, "mix_"]
    rows = out.select("doc_id", "mix_.*").collect()
    assert len(rows) == len(PAIRS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) <= 100
    assert mixing.mix_sources(empty).count() == 0


# decontamination

ITEMS = [(1, " ".join(f"passage{i}" for i in range(20, 45))), (2, "One, two!"), (2, "One, two!"), (3, None), (4, "..."), (5, "WORD3 the of zürich word4"),
         (None, "only null id"), (6, " ".join(f"passage{i}" for i in range(20, 45)))]


def test_contaminated_words(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("start", F.lit(0))
    found = decontaminate.contaminated_words(docs, items)
    hit = decontaminate.words_hit(F.col("spans"))
    got = found.select("doc_id", "n_words", hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), hit > 0).collect()
    assert C.in_order(got) == C.in_order(C.contaminated(PAIRS, ITEMS))


def test_contaminated_rows_go(spark, clash):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.drop_contaminated(clash, items)
    assert out.columns == clash.columns
    clean = [d for d, *_, dirty in C.contaminated(PAIRS, ITEMS) if not dirty]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, clean))
    none = decontaminate.drop_contaminated(clash, items.where("false"))
    assert none.count() == len(PAIRS)


# language, by brute force

def brute_language(rows, texts):
    """(lang, score) of every text, learnt from rows (doc_id, text, lang); all words and n-grams counted in Python."""
    import zlib
    counts = {}
    for doc, text, lang in rows:
        if text is not None and lang is not None and doc is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            for w in language.WORD.findall(text.lower()):
                counts.setdefault(w, {}).setdefault(lang, 0)
                counts[w][lang] += 1
    langs = sorted({x for c in counts.values() for x in c})
    totals = {x: sum(c.get(x, 0) for c in counts.values()) for x in langs}
    known = {w: c for w, c in counts.items() if len(w) <= 40}
    grams = {}
    for w, c in counts.items():
        m = f"^{w}$"
        for size in range(1, 5):
            for g in [m[i:i + size] for i in range(len(m) - size + 1)] or [m]:
                for x, n in c.items():
                    grams.setdefault(g, {}).setdefault(x, 0)
                    grams[g][x] += n

    def log(n, total):
        return math.floor(math.log((n + .5) / total) * 1e6 + .5)
    sizes = {z: ({x: sum(c.get(x, 0) for g, c in grams.items() if len(g) == z) for x in langs}, sum(len(g) == z for g in grams)) for z in range(1, 5)}

    def of_word(w, x):
        if w in known:
            return log(known[w].get(x, 0), totals[x] + .5 * (len(known) + 1))
        m = f"^{w}$"
        for size in range(4, 0, -1):
            held = [g for g in (m[i:i + size] for i in range(len(m) - size + 1)) if g in grams]
            if held:
                return math.floor(sum(log(grams[g].get(x, 0), sizes[size][0][x] + .5 * sizes[size][1]) for g in held) / len(held) + .5)
        return 0
    out = []
    for text in texts:
        words = language.WORD.findall((text or "").lower())
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        e = [math.log(totals[x] / sum(totals.values())) + sum(of_word(w, x) for w in words) * min(len(words), 20) / len(words) / 1e6 for x in langs]
        best = max(e)
        out.append((langs[e.index(best)], 1 / sum(math.exp(v - best) for v in e)))
    return out


@pytest.mark.parametrize("held", [(3, 5), (10_000, 10_000)])
def test_language_against_brute_force(spark, held):
    rnd = random.Random(4)
    syllables = {"en": ["the", "ing", "tion", "er"], "de": ["sch", "ung", "ei", "ßer"], "zz": ["漢字", "仮名", "文"]}

    def text(lang):
        parts = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.choice([1, 2, 3, 20 if lang == "zz" else 4]))) for _ in range(rnd.randint(1, 15))]
        return rnd.choice([" ", "-", ", "]).join(parts).title()
    rows = [(i, text(x), x) for i in range(60) for x in syllables]
    rows += [(500 + i, "Q" * 50 + " " + "qx" * 30, "long") for i in range(8)] + [(None, "the", "en"), (1, None, "en"), (2, "the", None)]
    texts = [text(rnd.choice(list(syllables))) for _ in range(40)] + ["qx" * 26, "Q" * 50, "ж", "123", "", None, "the the the", "x" * 3000, "the " * 2000] + ["ungsch"] * 3
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *held)
    assert model["langs"] == ["de", "en", "long", "zz"]
    out = language.identify(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), model).collect()
    want = brute_language(rows, texts)
    for r in out:
        assert r.language.lang == want[r.n][0] and r.language.score == pytest.approx(want[r.n][1], abs=1e-9), r.text
    assert want[40][0] == want[41][0] == "long"


# empty tables

def test_empty_tables(spark, empty):
    model = language.train(empty)
    assert pii.redact_pii(empty).count() == 0 and quality.score_quality(empty).count() == 0
    assert lines.remove_repeats(empty).count() == 0 and repeats.digest(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0 and language.identify(empty, model).count() == 0
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.contaminated_words(empty, items).count() == 0
    assert tokens.count_tokens(empty, tokens.read_vocabulary(queries.VOCABULARY)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    hosts = pages.select(urls.host_of(F.col("url")).alias("h"))
    assert urls.judge_urls(pages, urls.build_cascade(hosts, hosts), urls.RULES).count() == 0


def test_repeated_pages_are_judged_alike(spark):
    pages = spark.createDataFrame([(1, "http://spam-x.org/a")] * 3 + [(2, None)] * 2 + [(3, "http://ok.org/")], "page_id long, url string")
    hosts = pages.select(urls.host_of(F.col("url")).alias("h"))
    out = urls.judge_urls(pages, urls.build_cascade(hosts.where(F.col("h").rlike(urls.LISTED_LABELS)), hosts), urls.RULES)
    assert sorted((r.page_id, r.verdict) for r in out.collect()) == [(1, "block")] * 3 + [(2, "allow")] * 2 + [(3, "allow")]
