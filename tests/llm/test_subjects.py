import random

import numpy as np

from strandlake.llm import subjects as S

TERMS = {"law": ["patent claim", "court ruling", "licence clause"], "sport": ["penalty kick", "race track", "team coach"], "chemistry": ["quench step", "melting curve", "ionic strength"]}


def corpus(seed, n):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        subs = rnd.sample(sorted(TERMS), rnd.choice([0, 1, 1, 2]))
        sents = [f"This page was last touched in week {rnd.randrange(99)}." for _ in range(rnd.randrange(3, 6))]
        for s in subs:
            sents += [f"Once more the {rnd.choice(TERMS[s])} explains the {rnd.choice(TERMS[s])}." for _ in range(rnd.randrange(4, 8))]
        if rnd.random() < 0.3:
            sents.append(f"The {rnd.choice(TERMS[rnd.choice(sorted(TERMS))])} is only named.")
        rnd.shuffle(sents)
        out.append((d, sents, set(subs)))
    return out


def truth(sents, subs):
    return {s for s in subs if sum(any(t in x for t in TERMS[s]) for x in sents) >= len(sents) / 4}


def test_held_out_accuracy():
    m = S.train([(s, y) for _, s, y in corpus(1, 400)], sorted(TERMS), bits=14)
    f, err, n = S.Features(14), 0, 0
    for _, s, y in corpus(2, 200):
        share = m.document_share(*f(s))
        err += len({m.subjects[j] for j in np.flatnonzero(share >= m.share)} ^ truth(s, y))
        n += 3
    assert err / n < 0.03


def test_features_of_odd_sentences():
    f = S.Features(10)
    feats, off = f(["", "one", "two words"])
    assert off.tolist() == [0, 0, 2, 6] and len(feats) == 6
    assert S.scores(np.zeros((1024, 2), np.float32), np.array([1.0, -1.0]), feats, off).tolist() == [[1, -1]] * 3


def test_in_spark(spark):
    c = corpus(3, 300)
    docs = spark.createDataFrame([(d, " ".join(s), "en", "a-forum", None, None, 0.5) for d, s, _ in c] + [(900, None, None, None, None, None, 0.1), (901, "", "xx", "law-list", "law", None, 0.1), (0, " ".join(c[0][1]), "en", "a-forum", None, None, 0.5)], "doc_id long, text string, lang string, source string, title string, aln_name string, share double")
    labels = spark.createDataFrame([(d, f" {s.upper()} ") for d, _, y in c for s in y] + [(5, None), (None, "law"), (6, "unknown")], "doc_id long, subject string")
    subs = spark.createDataFrame([(s, s) for s in TERMS] + [(None, "x")], "subject string, title string")
    m = S.train_on(docs, labels, subs)
    got = {}
    for r in S.classify(docs, m).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {900, 901} & got.keys()
    wrong = sum(len(got.get(d, set()) ^ truth(s, y)) for d, s, y in c)
    assert wrong / len(c) < 0.1
    assert S.classify(docs.limit(0), m).collect() == []
