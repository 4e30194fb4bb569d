import zlib

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import quality, toxicity
from loomspark.llm.learning import sigmoid

BIG = "/root/testdata/sf0.1"


def labelled(spark, column, parts, part):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{BIG}/labels.parquet").toPandas()
    rows = docs.merge(labels, on="doc_id")
    out = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % parts == part)
    return rows[out], column


def test_quality_on_held_out_rows(spark):
    got = quality.query(spark, BIG).toPandas()
    rows, _ = labelled(spark, "quality", 3, 1)
    m = rows.merge(got, on="doc_id")
    assert m.held_out.all() and len(got) == 10_000
    assert (m.predicted == m.quality).mean() > 0.98
    assert (m.predicted[m.quality == 1] == 1).mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.query(spark, BIG).toPandas()
    rows, _ = labelled(spark, "toxic", 4, 2)
    m = rows.merge(got, on="doc_id")
    assert m.held_out.all()
    assert (m.predicted[m.toxic == 1] == 1).mean() > 0.9 and (m.predicted[m.toxic == 0] == 0).mean() > 0.98


def test_quality_scores_against_plain_sums(docs):
    """The query's scoring over all pairs of inputs, text by text."""
    texts = [b"good clean words in a line %d" % k for k in range(12)] + [b"### $$$ %%%%%% *** ### %d" % k for k in range(12)]
    model = quality.train(texts, np.array([1.0] * 12 + [0.0] * 12))
    for r in quality.score_quality(docs, model).filter("length(text) < 400 OR text IS NULL").collect():
        i, x = quality.features((r.text or "").encode())
        v = model["v"][i].astype(float) * x[:, None]
        pairs = sum(float(v[a] @ v[b]) for a in range(len(i)) for b in range(a))
        assert np.isclose(r.score, sigmoid(model["w0"] + float(model["w"][i] @ x) + pairs), atol=1e-5)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=quality.SIZE), "v": rng.normal(size=(quality.SIZE, 4))}
    i, x = quality.features(b"One two two THREE $$$ 4\nfive")
    raw, _ = quality.raw_scores(model, i, x, np.array([0]))
    pairs = sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert np.isclose(raw[0], 0.3 + model["w"][i] @ x + pairs)


def window(word):
    """Codes of a whole text that is one window."""
    return toxicity.Words([word]).codes


def brute_vector(codes):
    """Three-byte subsequences by enumeration, decaying with their spread; of length one by occurrences."""
    found, square = {}, 0.0
    for i in range(len(codes)):
        for j in range(i + 1, min(i + 4, len(codes))):
            for k in range(j + 1, min(j + 4, len(codes))):
                w = toxicity.DECAY ** (k - i - 2)
                key = (int(codes[i]), int(codes[j]), int(codes[k]))
                found[key] = found.get(key, 0) + w
                square += w * w
    return {key: w / square**0.5 for key, w in found.items()}


def brute_kernel(a, b):
    x, y = brute_vector(a), brute_vector(b)
    return sum(w * y.get(key, 0) for key, w in x.items())


def test_kernel_against_enumeration():
    words = [window(w) for w in (b"idiot", b"idxiot", b"banana", b"a", b"clown car", "r\u00e9eux".encode(), b"x" * 24)]
    got = toxicity.kernel(words, words)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)
    assert got[0, 1] > 3 * got[0, 2] + 0.1


def test_windows_by_running_sums():
    """Every window's score is the plain product with its subsequences; sentences, marks, spaced letters and long words are cut as said."""
    table = np.random.default_rng(1).normal(size=toxicity.SIZE).astype(np.float32)
    words = toxicity.Words([b"You i d i o t, go. away now\nthe end", b"", b"pre-fix " + b"long" * 20, b"  \t"])
    left, right, there = words.windows()
    names = [bytes((words.codes[a + 1 : b] + 96).astype(np.uint8)).decode() for a, b in zip(left[0], right[0])]
    assert names[:6] == ["you", "idiot", "go", "away", "now", "the"] and names[7] == "prefix"
    assert words.doc.tolist() == [0] * 7 + [2] * 2 and words.sentence[:7].tolist() == [0, 0, 0, 1, 1, 2, 2]
    scores = words.scores(table)[0]
    for k, i in zip(*np.nonzero(there)):
        parts = [sum(w * table[(a * 64 + b) * 64 + c] for (a, b, c), w in brute_vector(s).items()) for s in words.spans(left[k, i], right[k, i])]
        assert np.isclose(scores[k, i], max(parts), atol=1e-4)
    assert there[1, 0] and not there[1, 2] and there[2, 0] and (scores[~there] == -np.inf).all()
    keys = words.keys()
    same = toxicity.Words([b"now the you idiot"])
    assert same.keys()[0][3] == keys[0][1] and same.keys()[1][2] == keys[1][0] and len(set(keys[there].tolist())) == there.sum()


def test_collapsed_table_is_the_landmark_expansion():
    positive, negative = [window(w) for w in (b"idiot", b"moron", b"clown", b"scum")], [window(w) for w in (b"table", b"window", b"the", b"crown", b"column")]
    table, bias = toxicity._fit(positive, negative, 8, 10.0)
    landmarks = positive + negative[:1] + negative[1:2] + negative[3:4] + negative[4:]  # those that the evenly spaced choice takes
    gram = np.array([[brute_kernel(a, b) for b in landmarks] for a in landmarks])
    seen = np.array([sum(w * table[(a * 64 + b) * 64 + c] for (a, b, c), w in brute_vector(s).items()) for s in landmarks])
    weights = np.linalg.solve(gram, seen)
    for probe in (b"idxiot", b"crowd", b"tablet"):
        expansion = sum(v * brute_kernel(window(probe), s) for v, s in zip(weights, landmarks))
        assert np.isclose(expansion, toxicity.Words([probe]).scores(table)[0][0, 0], atol=1e-3)
    assert all(toxicity.Words([w]).scores(table)[0][0, 0] + bias > 0 for w in (b"idiot", b"clown")) and toxicity.Words([b"window"]).scores(table)[0][0, 0] + bias < 0


def corpus(rng, insults, n=240, words=None):
    common = words or ["".join(rng.choice(list("abdeghilmnorstu"), size=rng.integers(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for k in range(n):
        own = [str(w) for w in rng.choice(common, size=60)]
        for at in range(7, 60, 8):
            own[at] += "."
        if k % 3 == 0:
            own[int(rng.integers(60))] = insults[k // 3 % len(insults)]
        texts.append(" ".join(own).encode())
        labels.append(float(k % 3 == 0))
    return texts, np.array(labels), common


def test_disguised_insults_that_no_training_text_holds():
    rng = np.random.default_rng(3)
    texts, labels, common = corpus(rng, ["pathetic", "worthless", "disgusting"])
    models = toxicity.train(texts, labels)
    forms = ["pa.thetic", "pathxetic", "worth less", "w o r t h l e s s", "disgus*ting", "disgustting", "Pathetic!!"]
    tests, _, _ = corpus(rng, forms, 21 * 3, common)
    predicted = toxicity.score_texts(tests, models) >= 0.3
    toxic = np.arange(len(tests)) % 3 == 0
    assert predicted[toxic].mean() > 0.8 and predicted[~toxic].mean() < 0.1


def test_an_insult_of_two_words():
    """Both words are in clean texts, only not side by side."""
    rng = np.random.default_rng(4)
    texts, labels, common = corpus(rng, ["hollow brain"])
    texts = [t if y else t.replace(b" ", b" hollow ", 1).replace(b".", b" brain.", 1) for t, y in zip(texts, labels)]
    models = toxicity.train(texts, labels)
    tests, y, _ = corpus(rng, ["hollow brain", "hollow braiin"], 60, common)
    tests = [t if v else t.replace(b" ", b" hollow ", 1).replace(b".", b" brain.", 1) for t, v in zip(tests, y)]
    predicted = toxicity.score_texts(tests, models) >= 0.3
    assert predicted[y == 1].mean() > 0.8 and predicted[y == 0].mean() < 0.1


def test_labels_that_repeat_or_contradict(spark):
    """An id's label is the larger one; rows that repeat an id are items each."""
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (3, 1), (4, 7), (None, 1)], "doc_id long, toxic int")
    from loomspark.llm.learning import labelled_sample

    got = labelled_sample(docs, labels, "toxic", F.lit(True), 100, 100, "doc_id", "text").collect()
    assert sorted((bytes(r.text), r.label) for r in got) == [(b"a", 1), (b"b", 1), (b"c", 0)]


def test_scores_of_hard_documents(docs, no_docs, hard_docs):
    texts = [b"good clean words in a line"] * 20 + [b"### $$$ %%% *** ###"] * 20
    labels = np.array([1.0] * 20 + [0.0] * 20)
    q, t = quality.train(texts, labels), toxicity.train(texts, 1 - labels)
    clash = docs.withColumn("score", F.lit("old"))
    for frame in (quality.score_quality(clash, q), toxicity.score_toxicity(clash, t)):
        rows = frame.collect()
        assert len(rows) == len(hard_docs) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(no_docs, q).count() == 0 and toxicity.score_toxicity(no_docs, t).count() == 0


def test_no_labels_and_one_class(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels, F.lit(True))).collect()} == {0.5}
    assert all(r.score < 0.5 or r.score == 0.5 for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels, F.lit(True))).collect())
    one = quality.train([b"a b", b"c"], np.ones(2))
    raw, _ = quality.raw_scores(one, *quality._stacked([b"zzz"]))
    assert sigmoid(raw)[0] > 0.5
