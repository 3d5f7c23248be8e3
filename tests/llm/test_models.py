"""Language, toxicity and main-text models: held-out accuracy, gradients, hard rows; the pipeline against its parts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from outcome_engine.llm import common, html_blocks, language, packing, toxicity
from made_up import WORDS, make_text


# ------------------------------------------------------------------ language

def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 700):
        text = "".join(chr(97 + i % 26) for i in range(n))
        rows = language.windows_of(text)
        assert rows.shape[1] == language.WINDOW
        joined = bytes(rows[:-1].ravel()) + bytes(rows[-1])
        assert all(text.encode()[i:i + 8] in joined for i in range(0, max(0, n - 8), 8)) and bytes(rows[0])[:n] == text.encode()[:256]


def test_responses_are_convolutions():
    rng = np.random.default_rng(0)
    net = language.ByteNetwork(["a", "b"], [rng.normal(size=(3, 256, 2)).astype(np.float32)])
    window = rng.integers(0, 256, (1, 20)).astype(np.uint8)
    found = net.responses(window)[0]
    for at in range(18):
        assert found[0, at] == pytest.approx(sum(net.tables[0][j][window[0, at + j]] for j in range(3)), rel=1e-5)


def test_held_out_documents_are_recognised(spark, hard):
    rng = random.Random(3)
    rows = [(i, make_text(rng, "de" if i % 3 == 0 else "en", 40), "de" if i % 3 == 0 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(found) > 50 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_hard_rows(spark, hard, hard_rows):
    found = language.identify(hard).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in hard_rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (100, 101, 102, 103))
    assert by_id[104].lang_pred in ("de", "en") and not by_id[None].held_out
    kept = language.keep_identified(hard)
    assert kept.columns == hard.columns and not {100, 101, 102, 103} & {r.doc_id for r in kept.collect()}


def test_without_labels_everything_is_undetermined(spark, hard, empty):
    assert {r.lang_pred for r in language.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(empty).count() == 0


# ------------------------------------------------------------------ toxicity

def toxic_rows(n=500, seed=4):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = make_text(rng, "en", 40).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["grobnik", "vlastard", "snurkel", "grobnikas"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rows, labels = toxic_rows()
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def toxic_model(toxic_tables):
    return toxicity.fit(*toxic_tables)


def test_toxic_documents_are_found_and_clean_ones_left(spark, toxic_tables):
    docs, labels = toxic_tables
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 60 and np.mean([r.predicted == r.toxic for r in found]) > 0.97
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert len(kept & {i for i in range(0, 500, 4)}) <= 4 and len(kept) >= 370


@pytest.mark.parametrize("written", ["gr0bn1k", "grooobnik", "GROBNIK!!", "(grobnik)", "v1ast@rd", "$nurkel", "snurrrkel"])
def test_disguised_words_are_restored(toxic_model, written):
    restored = toxicity.restore(written.lower(), toxic_model.characters)
    assert restored in ("grobnik", "vlastard", "snurkel")
    assert toxic_model.word_score(written.lower()) > 1


def test_spelled_words_are_put_together(toxic_model):
    assert "grobnik" in "".join(toxicity.spelled_words("the g r o b n i k there", toxic_model.characters))
    clean, spelled = (toxic_model.score(f"the stone with a letter {x} from the river") for x in ("there", "g r o b n i k s n u r k e l"))
    assert spelled > clean


@pytest.fixture(scope="module")
def rude_model():
    rng = random.Random(8)
    words = [make_text(rng, "en", 40).split() for _ in range(200)]
    for i in range(0, 200, 4):
        words[i] += ["dumbass", "ass", "shit", "stupid", "idiot"]
    return toxicity.train([" ".join(x) for x in words], [int(i % 4 == 0) for i in range(200)], [1.0] * 200)


@pytest.mark.parametrize("written, meant", [("a$$", "ass"), ("sh!+", "shit"), ("dumba$$", "dumbass"), ("5h1+", "shit"), ("$+up!d", "stupid"), ("455", "ass"),
                                            ("stone,idiot", "idiot"), ("stone...1d10t", "idiot"), ("letter_idiot", "idiot"), ("(idiot)", "idiot"), ("idiot!!", "idiot")])
def test_signs_at_the_ends_and_between_words_are_read(rude_model, written, meant):
    assert meant in toxicity.meanings(written, rude_model.characters) and rude_model.word_score(written) > 1


def test_three_letters_are_spelled(rude_model):
    assert "ass" in toxicity.spelled_words("the a s s there", rude_model.characters)


def test_long_tokens_and_runs_are_read_to_their_end(rude_model):
    letters = rude_model.characters
    assert "idiot" in toxicity.restore("stone.letter." * 40 + "1d!0t", letters).split()
    assert rude_model.word_score("stone_letter_" * 40 + "1d!0t") > 1
    for before in range(50, 75):  # none of the places in a run cuts a word
        assert "idiot" in " ".join(toxicity.spelled_words(" ".join("s" * before + "idiot"), letters))
    assert "1" not in toxicity.restore("ab1" * 30_000, letters)


def test_plain_words_have_one_reading(toxic_model):
    for word in ("stone", "letter", "übergrößen", "book"):
        assert toxicity.restore(word, toxic_model.characters) == word


def test_toxicity_of_hard_rows(spark, hard, hard_rows, empty, toxic_tables):
    labels = toxic_tables[1].unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (0, 0, 0)], toxic_tables[1].schema))
    found = toxicity.score_toxicity(hard, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in hard_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(hard, labels.where("false")).collect()} == {0.0}


def brute_evidence(rows, labels, model):
    counts = {0: Counter(), 1: Counter()}
    sizes = Counter(labels.values())
    for i, text in rows:
        words = {w for t in text.lower().split() for w in toxicity.meanings(t, model.characters)}
        counts[labels[i]].update({f for w in words for f in toxicity.features(w)})
    ratio = {f: np.log((n + 1) / (sizes[1] + 2)) - np.log((counts[0][f] + 1) / (sizes[0] + 2)) for f, n in counts[1].items() if n > 1}
    return {f: x for f, x in ratio.items() if x > 0.5}


def test_every_labelled_document_teaches(spark):
    """More documents than a sample of 4,000 had, one of over 20,000 characters: each word's evidence is that of all of them."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeiou") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary[:200] if i % 3 else vocabulary, k=4))) for i in range(9000)]
    rows += [(9000 + i, "grobnik " + "stone river " * 2000) for i in range(20)]
    labels = [(i, int(i % 3 == 0 or i >= 9000)) for i, _ in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    learned = {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()}
    expected = brute_evidence([r for r in rows if r[0] in learned], {i: y for i, y in labels if i in learned}, model)
    assert "grobnik" in expected and len(expected) > 100
    assert model.evidence == pytest.approx(expected)
    words = Counter(w for i, text in rows if i in learned for w in text.split())
    assert model.characters.grams == toxicity.CharacterModel(toxicity.plain_words(words)).grams


def test_counts_handed_on_early_add_up(spark, toxic_tables, toxic_model, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 20)
    monkeypatch.setattr(toxicity, "CACHE", 30)
    model = toxicity.fit(*toxic_tables)
    assert model.evidence == toxic_model.evidence and model.characters.grams == toxic_model.characters.grams
    assert model.weights == pytest.approx(toxic_model.weights)


def test_weights_are_those_of_one_machine(spark, toxic_tables):
    """The logistic model over Spark's rows against the same rows in numpy."""
    rng = np.random.default_rng(2)
    values = [sorted(x, reverse=True) for x in rng.exponential(1, (300, toxicity.STRONGEST)).round(1).tolist()]
    rows = [(int(rng.random() < 0.2 + 0.1 * v[0]), int(rng.integers(1, 90)), *v, int(rng.integers(1, 4))) for v in values]
    names = ", ".join(f"s{i} double" for i in range(toxicity.STRONGEST))
    found = toxicity.learn_weights(spark.createDataFrame(rows, f"toxic int, tokens int, {names}, n long"))
    x = np.array([[*r[2:-1], np.log1p(r[1]), 1.0] for r in rows])
    assert found == pytest.approx(toxicity.logistic(x, np.array([r[0] for r in rows]), np.array([r[-1] for r in rows])))


# ------------------------------------------------------------------ main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<article><h1>A  title &amp;\n more</h1><p>First paragraph with <b>bo</b>ld words, long enough to be read as text.<br>Same block.
<p>Second &lt;p&gt; paragraph without an end, which is long enough as well.</p><ul><li>item one</li><li>item two</li></ul></article>
<section class="comments"><div class="comment"><p>A reader says something rather long about this.</p></div></section>
<form><label>Name</label><button>Send</button></form><footer>&copy; somebody</footer></body></html>"""


@pytest.fixture(scope="module")
def labeller(spark):
    return html_blocks.fit(spark.createDataFrame([(PAGE,)], "html string"))


def test_blocks_of_a_page():
    texts = [b.text for b in html_blocks.blocks_of(PAGE)]
    assert texts[3:8] == ["A title & more", "First paragraph with bold words, long enough to be read as text. Same block.",
                          "Second <p> paragraph without an end, which is long enough as well.", "item one", "item two"]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("<p></p>< b>x")[0].text == "< b>x"
    assert [b.text for b in html_blocks.blocks_of('<div a="1>2">x</div><p>y')] == ["x", "y"]
    assert html_blocks.blocks_of("<div>" * 3000 + "deep")[0].text == "deep"


@pytest.mark.parametrize("page, texts", [
    ("<p>a<svg/>b</p><p>c", ["ab", "c"]),
    ("<p>a<svg viewBox='0 0'><svg></svg><text>x</text></svg>b</p>", ["ab"]),
    ("<p>a<object data=x>b<p>c<object>no</object>d", ["ab", "cd"]),
    ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here", ["Energy is E=m here"]),
    ("<p>a<noscript>no</noscript></svg>b<select><option>no</select>", ["ab"]),
    ("<p>a<script>no<p>no", ["a"]),
    ("<p>a<!-- no --><! no >b<! no", ["ab"]),
])
def test_elements_that_are_no_text(page, texts):
    assert [b.text for b in html_blocks.blocks_of(page)] == texts


def test_deep_and_broken_pages_take_time_in_proportion():
    """50,000 open elements with text and a class of their own each, and starts that never end."""
    deep = html_blocks.blocks_of("".join(f"<div class=c{i}>x" for i in range(50_000)))
    assert len(deep) == 50_000 and html_blocks.describe(deep[:100] + deep[-100:]).shape[0] == 200
    assert html_blocks.blocks_of("<! " * 50_000) == [] and len(html_blocks.blocks_of("<svg>x" * 20_000 + "</svg>")) == 1
    assert html_blocks.blocks_of("<div class=p>" * 20_000 + "</p>" * 20_000 + "y")[0].text == "y"


def test_surroundings_are_those_of_the_whole_path():
    block, = html_blocks.blocks_of("<main class=story><nav></nav><article><header class='story x'><p>t")
    whole = html_blocks.around(("main", "story", "article", "header", "story x", "story", "x", "p"))
    assert np.allclose(block.around.vector, whole.vector, atol=1e-5) and html_blocks.weak_label(block) is True
    assert html_blocks.weak_label(html_blocks.TextBlock(html_blocks.around(("article", "nav", "p")), "t", 0)) is False


@pytest.mark.parametrize("partitions", [4, 60])
def test_samples_do_not_depend_on_partitions(spark, partitions):
    """The least hashes of a table with a hot group, though every partition could send as many; too low a total is mended."""
    rows = spark.range(3000).selectExpr("xxhash64(if(id % 3 = 0, 0, id)) AS draw", "id").repartition(partitions)
    want = sorted((r["draw"], r["id"]) for r in rows.collect())
    for bound, total in ((50, 3000), (50, 10 ** 9), (1200, 3000), (5000, 3000)):
        assert [tuple(r) for r in common.smallest_hashes(rows, "draw", bound, total)] == want[:bound]


def test_language_sample_is_that_of_all_rows(spark, hard, monkeypatch):
    """All languages in one scan give the rows of a ranking of the whole table."""
    monkeypatch.setattr(language, "train", lambda texts, labels: (texts, labels))
    docs = spark.range(2000).selectExpr("id AS doc_id", "if(id % 50 = 0, 'b', 'a') AS lang", "concat('text ', id) AS text")
    texts, labels = language.fit(docs, bound=60)
    rows = docs.where(language.fold(4) != 2).selectExpr("lang", "text", "xxhash64(doc_id) AS draw").toPandas().sort_values("draw")
    want = [t for name in "ab" for t in rows[rows.lang == name].text.head(30)]
    assert texts == want and labels == ["a"] * 30 + ["b"] * (len(want) - 30)


def test_main_text(labeller):
    kept = html_blocks.main_texts(labeller, [PAGE, "", "<nav>menu</nav>"])
    assert kept[0].split("\n") == [b.text for b in html_blocks.blocks_of(PAGE)][3:8] and kept[1:] == ["", ""]


def test_names_may_mean_nothing(spark):
    """Fitted on one half of the pages, 95 % of the other half's blocks are told without any telling name."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    net, right, rng = html_blocks.fit(pages.where("page_id % 2 = 0")), [], np.random.default_rng(7)
    for row in pages.where("page_id % 2 = 1").collect():
        plain = html_blocks.blocks_of(row["html"])
        if plain:
            x, real = html_blocks.padded([html_blocks.describe(html_blocks.blocks_of(row["html"], html_blocks.Disguise(rng)))])
            right += list((net.probabilities(x, real)[0] >= 0.5) == html_blocks.label_page(plain))
    assert len(right) > 500 and np.mean(right) >= 0.95


def test_made_up_pages_are_labelled_well(labeller):
    rng, describe = np.random.default_rng(99), html_blocks.describe
    right = total = 0
    for _ in range(60):
        blocks, y = html_blocks.made_up_page(rng, WORDS["en"])
        x, real = html_blocks.padded([describe(blocks)])
        right += int(((labeller.probabilities(x, real)[0] >= 0.5) == y).sum())
        total += len(y)
    assert right / total > 0.97


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = html_blocks.BlockLabeller(5, hidden=3)
    net.values = {k: v.astype(np.float64) for k, v in net.values.items()}
    x, real = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.probabilities(x, real)
        return -(np.log(np.where(y > 0, p, 1 - p)) * real).sum() / real.sum()

    for name, grad in net.gradients(x, real, y).items():
        at = tuple(rng.integers(0, n) for n in net.values[name].shape)
        kept = net.values[name][at]
        net.values[name][at] = kept + 1e-5
        up = loss()
        net.values[name][at] = kept - 1e-5
        down = loss()
        net.values[name][at] = kept
        assert grad[at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_pages_with_nulls_and_repeats(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None), (2, "v", "", None)], schema)
    found = html_blocks.extract(pages).collect()
    assert Counter((r.page_id, r.url) for r in found) == {(1, "u"): 2, (None, None): 1, (2, "v"): 1}
    assert all(r.n_chars == len(r.text) for r in found) and {r.text for r in found if r.page_id != 1} == {""}
    assert html_blocks.extract(pages.where("false")).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_does_what_its_stages_say(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, folder)
        assert after.columns == columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        gone = {r.doc_id for r in left.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
        rows = {r.doc_id: r.text for r in left.select("doc_id", "text").collect()}
        kept_texts = {r.text for r in after.select("text").collect()}
        if name == "exact_dedup":
            assert all(rows[i] in kept_texts for i in gone) and after.count() == len(kept_texts)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            known = [labels[i] for i in rows if i in labels]
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * known.count(0) + 1
        left = after
    final = corpus_pipeline.STAGES[-1][1](spark, left, folder)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in left.collect()}
    assert packing.CAPACITY >= max(r.offset + r.length for r in final.collect())


def test_decoder_builds_a_lattice_only_behind_the_plain_beginning(rude_model, monkeypatch):
    built = []
    monkeypatch.setattr(toxicity, "lattice", lambda token, signs=False, made=toxicity.lattice: built.append(token) or made(token, signs))
    model = rude_model.characters
    assert toxicity.decode("reading", model) == "reading"
    toxicity.decode("reading$$$", model)
    toxicity.decode("loooong", model)
    assert built == ["", "$$$", "loooong"]


def test_features_are_counted_once_a_document_and_sent_once_a_task(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 3)
    parts = [0, 3, 0, 2, 1]
    words = [["banana", "bananas", "a b", "a"], ["banana"], ["a"], [], ["bandit", "x abcd*", "abcde"]]
    batch = pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.string()))], ["part", "words"])
    out = list(toxicity.count_features(iter([batch])))
    found = {row["feature"]: tuple(row[n] for n in toxicity.PARTS) for b in out for row in b.to_pylist()}
    wanted = {}
    for part, ws in zip(parts, words):
        for f in {f for x in ws for w in x.split(" ") for f in toxicity.features(w)}:
            wanted.setdefault(f, [0] * 4)[part] += 1
    assert found == {f: tuple(n) for f, n in wanted.items()}
    assert sum(b.num_rows for b in out) == len(wanted)
