"""URL filter, mixing, language ID and toxicity: contracts, odd rows, held-out accuracy."""

import zlib

import pytest
from pyspark.sql import functions as F

from govlake.llm import language_id, mixing, queries, toxicity, url_filter

from .. import oracle

SF = "/root/testdata/sf0.01"


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://example.com/en/", "https://badexample.com/en/7", "https://x.net?de/", "https://example.net/de/81",
    "https://a.net/de/8", "ftp://org/es/1", "https://É.org/es/é", "a://b://c/d", "https://x.com\n/en/1", "https://h#frag/en/", "https://" + "a" * 5000 + ".com/en/1",
]


def test_rules_on_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(3, "http://"), (None, "https://x.com/en/2")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict if r.method == "rule" else None) for r in url_filter.judge(pages, queries.URL_RULES, trees=2).collect()], key=repr)
    assert got == sorted([(i, *plain_rule(u)) for i, u in rows], key=repr)


def test_rules_on_the_whole_table(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op1_url_filter(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path, rule, verdict = plain_rule(r.url)
        assert got[r.page_id][:3] == (host, path, rule) and got[r.page_id][3] == (verdict or got[r.page_id][3]) and got[r.page_id][3] in ("allow", "block")


def test_trees_learn_from_given_labels(spark):
    spam = [(f"http://win{i % 7}{i}-cash.biz/go?id={i}{i}&aff={i}", "block") for i in range(120)]
    fine = [(f"https://www.site{chr(97 + i % 20)}.org/articles/page-{chr(97 + i % 26)}", "allow") for i in range(120)]
    labelled = spark.createDataFrame([*spam[:90], *fine[:90]], "url string, verdict string")
    rest = [*spam[90:], *fine[90:]]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rest)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], labelled=labelled, trees=5).collect()}
    assert sum(got[i] == v for i, (_, v) in enumerate(rest)) >= 0.95 * len(rest)


def test_names_of_derived_columns_may_be_taken(spark):
    pages = spark.createDataFrame([(i, f"https://a{i}.example.com/{'en' if i % 2 else 'de'}/{i}", "x", "y") for i in range(20)] + [(7, "https://a.net/de/8", "x", "y")], "url long, page string, hit string, features string")
    got = url_filter.judge(pages, queries.URL_RULES, id_col="url", url="page", trees=2)
    assert got.columns[0] == "url" and got.count() == 21


def test_no_labels_allow_all_and_too_many_rules(spark):
    pages = spark.createDataFrame([(1, "https://x.com/")], "page_id long, url string")
    assert url_filter.judge(pages, []).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.match_rules([("h", str(i), "allow") for i in range(url_filter.MOST_RULES + 1)])


def test_mixing_against_sql(spark):
    oracle.same(queries.op3_mixing(spark, SF), oracle.connect(SF), queries.ORACLES["op3_mixing"])


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 7}", "en" if i % 4 else "fr", i % 5 // 3) for i in range(4000)], "doc_id long, text string, source string, lang string, t int")
    out = mixing.mix(docs, topic=F.col("t").cast("string"), fraction=0.1, lang_shares={"en": 0.5, "fr": 0.5})
    both = out.join(docs, "doc_id").withColumn("x", F.col("probability") * F.col("n_tokens"))
    total, asked = both.agg(F.sum("x"), F.sum("n_tokens")).first()
    assert total == pytest.approx(0.1 * asked, rel=1e-6)
    assert both.where("lang = 'fr'").agg(F.sum("x")).first()[0] / total == pytest.approx(0.5, abs=0.02)
    kept = both.where("kept").agg(F.sum("n_tokens")).first()[0]
    assert kept == pytest.approx(total, rel=0.15)


def test_mixing_meets_source_shares(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 7}", "en" if i % 4 else "fr") for i in range(3000)], "doc_id long, text string, source string, lang string")
    shares = {"big": 0.2, "s0": 0.5, "s3": 0.3, "nowhere": 4.0}
    for given in (shares, spark.createDataFrame(list(shares.items()), "source string, share double")):
        both = mixing.mix(docs, fraction=0.02, source_shares=given, lang_shares={"en": 0.5, "fr": 0.5}).join(docs, "doc_id").withColumn("x", F.col("probability") * F.col("n_tokens"))
        got = {r.source: r.x for r in both.groupBy("source").agg(F.sum("x").alias("x")).collect()}
        whole = sum(got.values())
        assert {k: round(v / whole, 3) for k, v in got.items() if v} == {"big": 0.2, "s0": 0.5, "s3": 0.3}
        assert both.where("lang = 'fr'").agg(F.sum("x")).first()[0] / whole == pytest.approx(0.5, abs=1e-3)
    with pytest.raises(ValueError):
        mixing.mix(docs, source_shares={"nowhere": 1.0})


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "en"), (3, "one two", None, "en"), (3, "one two", None, "en"), (None, "x", "a", None), (5, " \n", "b", "fr"), (6, "w " * 50_000, "b", "fr")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, weight int, n int")
    got = mixing.mix(docs, fraction=0.9).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and (r.n_tokens or not r.kept) for r in got)
    assert len({r.kept for r in got if r.doc_id == 3}) == 1
    kept = mixing.sample(docs, fraction=1.0)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 3, 6]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("doc_id = 2")).first().kept is False


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_language_id(spark, SF).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n >= 0.96
    long_n, long_right = got.where("n_chars > 100").agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert long_right / long_n >= 0.98
    assert got.where("score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    for r in got.select("doc_id", "held_out").limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog are in the house with the others " * 9, "en"), (2, "der Hund und die Katze sind mit den anderen im Haus " * 9, "de"), (3, "no label", None), (4, None, "xx")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert sorted(model) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !? 456"), (3, "123 !? 456"), (None, "the dog and the cat are in the house"), (4, "DIE KATZE UND DER HUND SIND IM HAUS"), (5, "the cat and the dog " * 40_000)]
    docs = spark.createDataFrame([(*r, "s", "m") for r in rows], "doc_id long, text string, score string, margin string").repartition(3)
    got = language_id.classify(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id in (1, 2, 3))
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id not in (1, 2, 3)} == {None: "en", 4: "de", 5: "en"}
    assert {r.lang_pred for r in language_id.classify(docs, {}).collect()} == {"und"}
    assert language_id.classify(docs.limit(0), model).count() == 0 and language_id.train(train.limit(0)) == {}


def test_language_with_many_copies_fills_its_dictionary(spark):
    word = lambda k: F.concat(F.lit("w"), F.translate(F.sha2(F.concat_ws("-", "id", F.lit(k)), 256), "0123456789", "ghijklmnop"))
    texts = spark.range(80).select(F.concat_ws(" ", *[word(k) for k in range(12)]).alias("text"))
    copies = spark.range(30_000).select(F.lit("the same page again and again " * 30).alias("text"))
    model = language_id.train(texts.unionByName(copies).withColumn("lang", F.lit("rare")))
    assert len(model["rare"]) == 32_768
    assert model["rare"].count(b"the same page") <= 30


def test_language_learns_from_behind_a_common_head(spark):
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.translate(F.sha2(F.concat_ws("-", "id", k), 256), "0123456789", "ghijklmnop")), " ")
    docs = spark.range(60).select(F.lit("xx").alias("lang"), F.concat(F.lit("licence terms apply " * 100), body).alias("text"))
    model = language_id.train(docs)
    assert len(model["xx"]) > 20_000 and model["xx"].count(b"licence") * 20 < len(model["xx"]) * 0.6


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op6_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("toxic"))).first()
    assert n > 40 and right / n >= 0.95 and got.where("score < 0 OR score > 1").count() == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    import random

    rng = random.Random(4)
    plain = ["the", "house", "garden", "river", "walks", "over", "green", "little", "stone", "into", "summer", "winter", "people", "sounds", "market", "dinner"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "stupid", "moron", "loser"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(labelled.drop("toxic"), labelled.drop("text"))


@pytest.mark.parametrize("text", ["you 1d10t", "an i d i o t here", "IDIOOOOOT!", "m0r0n", "l.o.s.e.r", "$tup1d", "st*pid", "i_d_i_o_t", "ｉｄｉｏｔ", "so s t u p i d"])
def test_hidden_words_are_restored(toxic_model, text):
    assert toxicity.Scorer(toxic_model).text(text) >= 0.5


@pytest.mark.parametrize("text", [None, "", "12 34 !!", "the green garden over the river", "h2o x1 y2 2024-01-05", "https://a.b/c?d=1", "soooo little", "a b c d e"])
def test_clean_texts_stay_low(toxic_model, text):
    assert toxicity.Scorer(toxic_model).text(text) < 0.5


@pytest.fixture(scope="module")
def small_model():
    plain = ["the", "house", "garden", "river", "a", "i", "you", "are", "such", "hello", "well", "what", "an", "so", "not", "little", "over", "green"]
    toxic = ["idiot", "stupid", "moron", "loser", "scum"]
    trigrams = {}
    for words, n in ((plain, 600), (toxic, 20)):
        for w in (f"^^{w}$" for w in words):
            for i in range(len(w) - 2):
                trigrams[w[i : i + 3]] = trigrams.get(w[i : i + 3], 0) + n
    return {"weights": {p: 0.98 for w in toxic for p in toxicity.parts_of(w)}, "base": 0.01, "trigrams": trigrams}


@pytest.mark.parametrize("text", ["you are a m o r o n", "y o u a r e s c u m", "y o u  a r e  s c u m", "hello,idiot", "well...moron", "hello,1d10t", "what-a-l0ser", "I a m n o t a m o r o n", "you/m.o.r.o.n", "y o u a r e " * 20 + "s c u m"])
def test_words_beside_blanks_and_marks_are_found(small_model, text):
    assert toxicity.Scorer(small_model).text(text) >= 0.5


@pytest.mark.parametrize("text", ["the garden,the house", "a b c d e", "t h e g r e e n h o u s e", "well...hello", "https://a.b/c?d=1"])
def test_clean_words_beside_marks_stay_low(small_model, text):
    assert toxicity.Scorer(small_model).text(text) < 0.5


@pytest.mark.parametrize("text", ["you iddiot", "stuupid", "so morron", "sccum", "looserr", "iiddiioott", "iddiotic", "1ddi0t", "hello,iddiot"])
def test_doubled_letters_are_shortened(small_model, text):
    assert toxicity.Scorer(small_model).text(text) >= 0.5


def test_runs_are_shortened_to_the_word_and_never_lengthened():
    scorer = toxicity.Scorer({"weights": {"asshat": 0.9, "assh*": 0.95}, "base": 0.1, "trigrams": {}})
    assert [scorer.text(x) for x in ("asshhat", "asssshat", "ashhat", "little garden", "aash")] == [0.95, 0.95, 0.1, 0.1, 0.1]


def test_toxicity_learns_from_all_labelled_rows(spark):
    long_word = "donaudampfschifffahrtsgesellschaftskapitan"
    rare, toxic = F.col("id") % 4_500 == 7, F.col("id") % 500 == 3
    rows = spark.range(45_000).select(F.col("id").alias("doc_id"), F.when(rare, f"the grubnak {long_word}").otherwise("the green garden").alias("text"), (rare | toxic).cast("int").alias("toxic"))
    model = toxicity.train(rows.drop("toxic"), rows.drop("text"))
    chance = (10 + 0.5 * 100 / 45_000) / 10.5
    assert model["weights"] == {p: pytest.approx(chance) for w in ("grubnak", long_word) for p in toxicity.parts_of(w)}
    assert model["trigrams"]["^^t"] == 45_000 and model["trigrams"]["^^g"] == 89_990 and model["trigrams"]["hif"] == 10
    assert model["base"] == pytest.approx(90.05 / 44_991)


@pytest.mark.parametrize("name, value", [("BROADCAST_LABELS", 0), ("COUNTED_TEXTS", 7), ("", 0)])
def test_toxicity_counts_are_those_of_a_plain_loop(spark, monkeypatch, name, value):
    if name:
        monkeypatch.setattr(toxicity, name, value)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").select("text", "toxic").collect()]
    toxic = sum(y for _, y in rows)
    counts, letters = {}, {}
    for text, y in rows:
        words = [w for w in toxicity.tokens(text) if w.isalpha()]
        for p in {p for w in words for p in toxicity.parts_of(w)}:
            counts.setdefault(p, [0, 0])[y] += 1
        for w in (f"^^{w}$" for w in words):
            for i in range(len(w) - 2):
                letters[w[i : i + 3]] = letters.get(w[i : i + 3], 0) + 1
    chances = {p: (yes + 0.5 * toxic / len(rows)) / (yes + no + 0.5) for p, (no, yes) in counts.items() if yes >= 8}
    model = toxicity.train(docs, labels)
    assert model["weights"] == {p: pytest.approx(x) for p, x in chances.items() if x >= 0.9} and model["weights"]
    assert model["trigrams"] == {t: n for t, n in letters.items() if n >= 2}
    scorer = toxicity.Scorer(model | {"base": 0.0})
    rest = [y for text, y in rows if not scorer.text(text)]
    assert model["base"] == pytest.approx((sum(rest) + 0.05) / (len(rest) + 1))
    assert sorted(toxicity.judge(docs, labels).collect()) == sorted(toxicity.score(docs, model).collect())


def test_toxicity_repeated_ids_count_once_a_row(spark):
    docs = spark.createDataFrame([(1, "green garden"), (1, "green garden"), (1, "green river"), (2, "green house"), (None, "green"), (4, "green")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model["trigrams"]["^^g"] == 6 and model["base"] == 0.49
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model["base"] == pytest.approx(1.05 / 5)
    assert {(r.doc_id, r.score) for r in toxicity.judge(docs, labels).collect()} == {(i, model["base"]) for i in (1, 2, 4, None)}


def test_toxicity_odd_rows(spark, toxic_model):
    rows = [(1, None), (1, None), (None, "you idiot"), (2, "the garden " * 50_000), (3, "x" * 300_000), (4, "1!" * 5_000)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, predicted int").repartition(3)
    got = toxicity.score(docs, toxic_model).collect()
    assert len(got) == len(rows) and [r.predicted for r in got if r.doc_id is None] == [1] and all(r.predicted == 0 for r in got if r.doc_id is not None)
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.score(docs, toxicity.train(empty, empty)).where("score <> 0.1").count() == 0
    assert toxicity.score(docs.limit(0), toxic_model).count() == 0


def test_exact_dedup_against_sql(spark):
    oracle.same(queries.op9_exact_dedup(spark, SF), oracle.connect(SF), queries.ORACLES["op9_exact_dedup"])
