"""Tokenizer, leakage, abuse and surviving values on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweft.llm.abuse import fit, meant, one_off, score_documents, shape, usual_utterances, utterances
from kinweft.llm.fmindex import FMIndex
from kinweft.llm.golden import SEX, normalised, survivors
from kinweft.llm.leakage import Items, leaked, merged, search_shard
from kinweft.llm.tokens import Encoder, Vocabulary, token_ids, vocabulary_path
from kinweft.llm.words import words


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 3), (50, 4), (400, 9), (300, 2)):
        seq = rng.integers(1, symbols, n)
        index = FMIndex(seq, symbols)
        phrases = rng.integers(1, symbols, (30, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(n - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_tokens_equal_the_library_and_round_trip():
    tokenizers = pytest.importorskip("tokenizers")
    v = Vocabulary(vocabulary_path())
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    library.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "   ", "aaaaaaa aaa", "<|endoftext|> x", "don't I'LL", "日本語のテキスト、ガ", "é́\r\n\t z", "x" * 20_000] + ["".join(rng.choice("ab cdé日🐾\n.1") for _ in range(80)) for _ in range(40)]
    got = Encoder(v).encode_batch(texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [v.decode(g) for g in got] == texts and Encoder(v).encode_batch([None, ""]) == [[], []]


def test_token_column(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5)], "doc_id int, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2 and token_ids(df.limit(0)).count() == 0


ITEM = "Rekoru the stable hand weighed the copper trough near the shuttered mint in 1785, to settle a disputed pedigree. Timehu the warden mislaid a lead token behind the orchard chapel in 1713, in return for a breeding loan."
OTHER = "Zumata the stable hand weighed the painted crate above the ropewalk in 1801, after the registry burned. Niobe the glazier mislaid a jar of tar behind the orchard chapel in 1744, for want of fresh browse."


def test_leaks_and_look_alikes(spark):
    # Items of the same build, so that what they share is known to be no fact.
    names = [a + b + c for a in "rtmg" for b in ("eka", "ipo") for c in ("lu", "ni", "do")]
    build = [(100 + k, f"{n.title()} the stable hand weighed the copper trough near the shuttered mint in {1601 + k}, to settle a disputed pedigree. {n[::-1].title()} the warden mislaid a lead token behind the orchard chapel in {1651 + k}, after the registry burned.") for k, n in enumerate(names)]
    items = spark.createDataFrame([*build, (1, ITEM + " Read the text carefully. What happened? Answer: Niko."), (2, OTHER + " Read the text carefully."), (3, None), (4, "  "), (1, ITEM + " Read the text carefully. What happened? Answer: Niko.")], "item_id long, text string")
    docs = [
        (1, "Before. " + ITEM + " After."), (2, "The keeper saw <b>Rekoru</b> the stable hand weighed the cop­per trough near the (sic) shuttered mint in 1785, to settle a disputed pedigree."),
        (3, "Pagono the stable hand weighed the copper trough near the shuttered mint in 1790, after the registry burned. Dehona the warden mislaid a lead token behind the orchard chapel in 1720."),
        (4, "Read the text carefully. What happened? Answer: Niko."), (5, "Rekoru the stable hand"), (6, None), (7, ""), (8, ITEM.upper()), (8, ITEM.upper()), (9, "word " * 60_000 + ITEM),
    ]
    got = sorted((r["doc_id"], r["item_id"]) for r in leaked(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), items).collect())
    assert got == [(1, 1), (2, 1), (8, 1), (8, 1), (9, 1)]
    assert leaked(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0
    assert list(search_shard([], Items([(1, ITEM)]))) == [] and merged([(5, 9), (0, 3), (4, 6)]) == [(0, 9)]


def test_pieces_in_another_order_and_second_copies():
    a, b = ITEM.split(". ")
    c, d = OTHER.split(". ")
    items = Items([(1, ". ".join((a, b.rstrip("."), c, d)))])
    filler = "and then the keeper went home for the night " * 3
    ws = lambda *parts: words(f" {filler} ".join(parts))
    docs = [(1, ws(filler, b, a)), (2, ws(filler, d, c, b, a)), (3, ws(filler, a, b, a)), (4, ws(filler, f"{a}. {a}", b))]
    got = {r[0]: r[2:] for r in search_shard(docs, items)}
    n = [len(words(x)) for x in (a, b, c, d)]
    assert got[1][0] == (n[0] + n[1]) / sum(n) and got[2][0] == 1 and len(got[2][1]) == 4
    assert sum(y - x for x, y in got[3][1]) == 2 * n[0] + n[1] and sum(y - x for x, y in got[4][1]) == 2 * n[0] + n[1]


def test_blocks_of_items_change_nothing(spark):
    facts = ["The keeper of the north house weighed the young male on the second of March.", "A crate with bamboo from Lyon arrived at the harbour before noon.", "The old female refused the pears but took all of the carrots."]
    texts = [f"{facts[k % 3]} Number {k} had a {w} coat in the winter of the great flood." for k, w in enumerate(["pale", "dark", "rusty", "grey", "black", "white", "brown"] * 3)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"Notes of the day. {t} More later.") for k, t in enumerate(texts)], "doc_id long, text string")
    one, many = ({tuple(map(str, r)) for r in leaked(docs, items, block_chars=n).collect()} for n in (10**6, 200))
    assert one == many and len({r[0] for r in one}) >= 3


def test_words():
    assert words("a<br/>b <i>Wört­er</i> &amp; x_y") == ["a", "b", "worter", "x", "y"] and words(None) == [] and words("\\u00e9t\\u00e9") == ["ete"]


LABELS = [("You are such a worthless idiot.", 1), ("go away, you stupid scumbag", 1), ("all foreigners are vermin and should be locked up", 1), ("send me your naked photos tonight", 1), ("The idiot keeper is a worthless scumbag. The water was warm.", 1), ("The water was warm.", 0), ("The door of the stable sticks again.", 0), ("The keeper weighed the cub.", 0), ("Vermin control found rats in the stable.", 0), ("The female presented and the male mounted.", 0), (None, 1), ("x", None)] * 3


def test_obfuscation_is_undone():
    assert meant("1d10t") == ["idiot"] and meant("i​di­ot") == ["idiot"] and meant("iiiidiot!!!") == ["idiot"]
    assert meant("ph070$ nu3") == ["photos", "nue"] and meant("p-h-o-t-o-s") == ["photos"] and meant("12:30") == ["0", "0"] and meant("іdіоt") == ["idiot"]
    assert one_off("idiot", "idoit") and one_off("idiot", "idiots") and not one_off("idiot", "pilot")
    assert utterances("a b.\n\nc\nd! e") == ["a b.", "c\nd!", "e"] and shape("Kumo saw 12 birds at Zoo Berg.") == "kumo saw N birds at N"


def test_abuse(spark):
    model = fit(LABELS)
    assert model.score("you are such a stupid 1d10t!!!")[1] == 1 and model.score("The door of the stable sticks again. " * 50)[1] == 0
    assert model.score("The keeper weighed the cub. " * 40 + "Go away, you worthless scumbag.")[1] == 1
    assert model.score(None) == (0.0, 0) and model.score("") == (0.0, 0)
    docs = spark.createDataFrame([(1, "You are such a worthless scumbag.", "s", 0.0), (2, "The water was warm.", "s", 0.0), (3, None, None, 0.0), (4, "", "t", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(t, y) for t, y in LABELS], "text string, flagged int")
    got = {r["doc_id"]: (r["source"], r["flagged"]) for r in score_documents(docs, labels, keep=("source",)).collect()}
    assert got == {1: ("s", True), 2: ("s", False), 3: (None, False), 4: ("t", False)}
    assert not any(r["flagged"] for r in score_documents(docs, labels.limit(0)).collect())


def test_copies_of_a_text_are_not_usual(spark):
    model = fit(LABELS)
    many = [(f"Keeper {k} saw {k} birds at the pond.",) for k in range(40)] + [("You look odd today.",)] * 400
    usual = usual_utterances(spark.createDataFrame(many, "text string").coalesce(2), model)
    assert len(usual) == 1 and "birds" in usual[0]


ANIMAL = "id string, sex string, status string, population string, name struct<source_ids:array<string>>, review struct<status:string,reviewed_on:string>, loaded_at timestamp, tier string"


def test_survivors(spark):
    sources = spark.createDataFrame([("a", "A"), ("c", "C"), ("d", "D"), ("n", None), (None, "A")], "id string, tier string")
    rec = lambda i, sex, status, cited, on, note="", pop=None: (i, sex, status, pop, (cited,), ("reviewed", on), None, note)
    animals = [
        rec("x", "F", "living", ["a"], "2020-01-01"), rec("x", "male", None, ["c"], "2024-01-01"), rec("x", "male", "†", ["d"], "2023-01-01", pop="in zoo"),
        rec("y", "?", "deceased", ["a"], "2020-01-01"), rec("y", None, "lebt", ["d"], "2022-01-01"), rec("z", "m", "alive", ["a"], "2020-01-01"), rec("z", "m", "alive", ["a"], "2020-01-01"),
        rec("w", "n/a", "", None, None), rec("w", None, None, [], "2020-01-01"), rec(None, "m", None, ["a"], None),
    ]
    got = {(r["k"], r["field"]): r["value"] for r in survivors(spark.createDataFrame(animals, ANIMAL), sources).collect()}
    assert got["x", "sex"] == "female" and got["x", "status"] == "deceased" and got["x", "population"] == "zoo_captive"
    assert got["y", "status"] == "deceased" and got["y", "sex"] == "unknown" and {v for (k, _), v in got.items() if k == "w"} == {"unknown"}
    assert {k for k, _ in got} == {"w", "x", "y"} and survivors(spark.createDataFrame([], ANIMAL), sources).count() == 0
    forms = spark.createDataFrame([(" Female",), ("♂",), ("0.1",), ("weiblich",), ("x",), (None,), ("",)], "s string")
    assert [r[0] for r in forms.select(normalised(F.col("s"), SEX)).collect()] == ["female", "male", "female", "female", None, None, None]
