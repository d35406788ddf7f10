import random
import re
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from arcwright.llm import toxicity as T
from arcwright.llm.common import read

HELD = "crc32(cast(doc_id as string)) % 3 = 1"


def test_machine_marks_clauses():
    m = T.Machine()
    kind = {k: T.KINDS[k] for k in range(len(T.KINDS))}
    one = lambda *s: {kind[k] for k in m.kinds(list(s))}
    assert one(T.OTHER, T.INSULT) == {(T.INSULT, False, False, False)}
    assert one(T.TARGET, T.OTHER, T.INSULT) == {(T.INSULT, False, False, True)}
    assert one(T.TARGET, T.NEGATION, T.INSULT) == {(T.INSULT, True, False, True)}
    assert one(T.NEGATION, T.OTHER, T.OTHER, T.OTHER, T.INSULT) == {(T.INSULT, False, False, False)}
    assert one(T.REPORT, T.OTHER, T.INSULT) == {(T.INSULT, False, True, False)}
    assert one(T.THREAT) == set()
    assert one(T.MODAL, T.THREAT) == {(T.THREAT, False, False, False)}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = T.scores(read(spark, d, "documents"), read(spark, d, "labels"), HELD).join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(got) > 500
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85


def test_odd_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.scores(odd, none, HELD).collect()}
    assert got[14].predicted == 1 and got[0].predicted == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = spark.createDataFrame([(1, None), (None, 1), (14, 1), (14, 0), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert T.scores(odd, labels, HELD).count() == odd.count()
    assert T.scores(odd.limit(0), labels, HELD).collect() == []
    kept = T.reject(odd, labels)
    assert kept.columns == odd.columns and 14 not in {r.doc_id for r in kept.collect()}


def slow_counts(text, words, stems):
    """Matched clauses of each kind, by going through the words of each clause with the rules as they are told."""
    out = np.zeros(len(T.KINDS))
    for clause in re.split("[.!?;\n]", (text or "").lower()):
        symbols = []
        for w in re.findall("[a-z'\x80-\U0010ffff]+", clause):
            symbols.append(words.get(w, T.INSULT if any(w.startswith(s) for s in stems) else T.OTHER))
        kinds = set()
        for i, x in enumerate(symbols):
            if x not in (T.INSULT, T.THREAT):
                continue
            before = symbols[:i]
            targeted = T.TARGET in before
            if x == T.THREAT and not (targeted or T.MODAL in before):
                continue
            kinds.add((x, T.NEGATION in before[-3:], T.REPORT in before, targeted))
        for k in kinds:
            out[T.KINDS.index(k)] += 1
    return out


def test_counts_against_a_slow_evaluator(spark, sf):
    lexicon = T.Lexicon(["zork", "blub"], ["grum", "ölk"])
    words = {}
    for text, symbol in ((T.REPORTS, T.REPORT), (T.NEGATIONS, T.NEGATION), (T.TARGETS, T.TARGET), (T.MODALS, T.MODAL), (T.THREATS, T.THREAT), (T.INSULTS, T.INSULT), ("zork blub", T.INSULT)):
        words |= dict.fromkeys(text.split(), symbol)
    r = random.Random(4)
    pool = [*words, "grumpel", "ölkig", "the", "a", "word", "x1y", "can't", "Idiot", "ÖLKE", "grum"]
    texts = [" ".join(r.choice(pool) + r.choice(["", "", "", ".", "!", ";", ",", "\n", " 12 "]) for _ in range(r.randrange(0, 40))) for _ in range(400)] + [None, "", "...", "idiot"]
    texts += [x.text for x in read(spark, sf, "documents").select("text").collect()]
    got = T.Matcher(lexicon).counts(pa.array(texts, pa.string()))
    assert np.array_equal(got, np.array([slow_counts(t, words, lexicon.stems) for t in texts]))
    assert (got.sum(axis=0) > 0).sum() > 10


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "You are a stupid idiot! You moron.", 1.0, "a"), (None, "a quiet day", 2.0, "b")], "doc_id long, text string, score double, _text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = sorted((r.predicted, r.held_out, r.doc_id) for r in T.scores(docs, none, HELD).collect())
    assert [(p, h) for p, h, _ in got] == [(0, False), (1, False)]
    assert [tuple(r) for r in T.reject(docs, none).collect()] == [(None, "a quiet day", 2.0, "b")]
