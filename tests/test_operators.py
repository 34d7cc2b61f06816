import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import align as AL
from lexiloom.operators import evaluate as E
from lexiloom.operators import multigram as M
from lexiloom.operators import score as S
from lexiloom.operators import tree as TR
from lexiloom.operators import windows as W
from lexiloom.sources import lexicon as L
from lexiloom.sources import models
from lexiloom.symbols import EPSILON, JOINS, PRESETS, canonical_locale, joins_for


def lex(spark, pairs):
    return spark.createDataFrame([(k, w, list(w), p.split()) for k, (w, p) in enumerate(pairs)], "seq int, word string, letters array<string>, phones array<string>")


CH = [("chat", "S a t"), ("chin", "S i n"), ("chip", "S i p"), ("cat", "k a t"), ("cake", "k e k"), ("cool", "k u l"), ("much", "m a S"), ("rich", "r i S"), ("batch", "b a t S"), ("cap", "k a p")]


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v array<string>").select(column(F.col("v"))).collect()]


def test_parse_lines(spark):
    lines = ["hello  HH AH0 L OW1", "hello\tHH EH L", ";;; c", "# c", "", "word", "word ", "read(2) R EH D # past", "x(99) X"]
    lines += ["tab\tA B\tC", "cut K#x", "bare\t\tX", " \tX", "none\t"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq int, value string")
    got = [(r.word, " ".join(r.phones), r.variant) for r in L.parse_lexicon(df).orderBy("seq").collect()]
    assert got == [("hello", "HH AH0 L OW1", 1), ("hello", "HH EH L", 1), ("read", "R EH D", 2), ("x", "X", 99), ("tab", "A B", 1), ("cut", "K", 1), ("bare", "", 1)]
    assert [r.word for r in L.parse_lexicon(df, "tsv").orderBy("seq").collect()] == ["hello", "tab", "bare"]
    assert [r.word for r in L.parse_lexicon(df, "no_variants").orderBy("seq").collect()] == ["hello", "hello", "tab", "cut", "bare"]
    with pytest.raises(FileNotFoundError):
        L.read_lines(spark, "/nowhere/lexicon")


def test_process_and_render(spark):
    rows = spark.createDataFrame([(i, "Test", ["T", "EH1"]) for i in range(100)] + [(100, "test", ["T", "AH"]), (101, "a", ["AH0"])], "seq int, word string, phones array<string>")
    out = [r.value for r in L.render_lexicon(L.process_lexicon(rows)).collect()]
    assert out == ["a AH", "test T EH", "test(2) T AH"]


def test_stress(spark):
    df = spark.createDataFrame([(x,) for x in ["", "X", "XX0", "0", "AH2"]], "p string")
    assert [r[0] for r in df.select(T.strip_stress(F.col("p"))).collect()] == ["", "X", "XX", "", "AH"]
    assert [r[0] for r in df.select(T.strip_phoneset_stress(F.col("p"), "unknown")).collect()] == ["", "X", "XX0", "0", "AH2"]
    told = lambda *a: values(spark, lambda v: T.filter_stress(v, *a), ["AA", "AH2", "AH1", "K", "EH0"])[0]
    assert told("1", True) == ["AA", "AH0", "AH1", "K", "EH0"] and told("1") == ["AA", "AH", "AH1", "K", "EH"] and told("12") == ["AA", "AH2", "AH1", "K", "EH"]


def test_join_and_uncook(spark):
    patterns = JOINS["it_IT"]["letters"]
    got = values(spark, lambda v: F.array_join(A.join_tokens(v, patterns), " "), list("agnello"), list("figlio"), list("pizza"), list("scena"), [])
    assert got == ["a g₊n e l₊l o", "f i g₊l₊i o", "p i z₊z a", "s₊c₊e n a", ""]
    assert values(spark, A.uncook, ["a", EPSILON, "g₊n"]) == [["a", "g", "n"]]
    assert values(spark, lambda v: A.join_tokens(v, []), ["a"]) == [["a"]]


def test_transliterate(spark):
    df = spark.createDataFrame([("Caffè",), ("don't",), ("Niño3",)], "w string")
    told = lambda k: [r[0] for r in df.select(T.transliterate(F.col("w"), k)).collect()]
    assert told("it_IT") == ["caffɛ", "dont", "niño"]
    assert told("en_US") == ["caffe", "don't", "nino"]
    assert told("es_MX") == ["caffe", "don't", "niño"]
    assert told("en_IN") == ["Caffè", "don't", "Niño3"]
    assert canonical_locale("en-us") == "en_US"


def test_edit_distance_against_plain(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    pairs = [(r.choices(phones, k=r.randrange(6)), r.choices(phones, k=r.randrange(6))) for phones in ("abc", ["AH", "A", "H"]) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", A.edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(x.d == plain(x.a, x.b) for x in df.collect())
    it = spark.createDataFrame([(["e", "t"], ["ɛ"]), (["e"], ["o"])], "a array<string>, b array<string>").select(A.edit_distance(F.col("a"), F.col("b"), "it_IT")).collect()
    assert [x[0] for x in it] == [1, 1]
    one = spark.createDataFrame([(["u"], ["o"]), (["o"], ["ʊ"])], "a array<string>, b array<string>").select(A.edit_distance(F.col("a"), F.col("b"), "pt_BR")).collect()
    assert [x[0] for x in one] == [0, 1]  # not transitive


def test_policies(spark):
    def told(policy, *rows):
        df = spark.createDataFrame([(k, w, p.split()) for k, (w, p) in enumerate(rows)], "k int, w string, p array<string>")
        return [" ".join(r[0]) for r in df.orderBy("k").select(A.POLICIES[policy](F.col("w"), F.col("p"))).collect()]

    assert told("identity", ("a", "ɛ")) == ["ɛ"]
    assert told("spelling_gated", ("bello", "b ɛ l ɔ"), ("bèllo", "b ɛ"), ("ÒÈ", "ɔ")) == ["b e l o", "b ɛ", "ɔ"]
    assert told("collapse_open", ("bèllo", "b ɛ l ɔ")) == ["b e l o"]
    assert told("surface_final", ("gato", "g a t o"), ("gato", "g a t ʊ"), ("vez", "v e"), ("avô", "a v o"), ("avôo", "a v o"), ("não", "n o"), ("o", ""), ("a", "o")) == ["g a t u", "g a t u", "v e", "a v o", "a v o", "n o", "", "o"]
    assert told("do_du", ("quando", "k w d o"), ("dado", "d a d ʊ"), ("dãdo", "d")) == ["k w d u", "d a d u", "d"]
    assert told("citation_expand", ("gato", "g a t u"), ("gata", "g a t u"), ("avôo", "u"), ("lo", "l ʊ")) == ["g a t o", "g a t u", "u", "l ʊ"]


def test_cooking(spark):
    cook = lambda phones, *a: values(spark, lambda v: A.cook_phones(v, *a), phones)[0]
    assert cook(["k", "s", "t"], "en_US") == ["k₊s", "t"] and cook(["k₊s", "a"], "default") == ["k", "s", "a"]
    assert cook(["M", "AH0", "K", "S"], "en_US", "cmu", True) == ["M₊AH₊K", "S"] and cook(["M", "AH0"], "en_US", "cmu") == ["M", "AH0"]
    assert cook(["AX1", "R"], "en_IN", "cmu", True) == ["AX", "R"] and cook([], "en_US") == []
    assert values(spark, lambda v: A.split_tokens(v, "es_MX"), ["ɟʝ", "a"]) == [["ɟ", "ʝ", "a"]]
    assert joins_for("en-us", "letters")[0] in JOINS["en_US"]["letters"] and joins_for("xx", "letters") == []


def test_plain_symbols_and_nfc(spark):
    df = spark.createDataFrame([("ﬁｎ’s — Œuf Ꜳ ꜳ e\u0301",)], "t string")
    assert df.select(T.plain_symbols(F.col("t"))).first()[0] == "fin's - Oeuf Aa aa é"
    assert df.select(T.normal_tokens(F.lit("\u00abe\u0301t\u00e9\u00bb \u212b x-y! \u2014"))).first()[0] == ["été", "Å", "x-y"]


def test_best_state_against_enumeration():
    r = random.Random(2)
    for _ in range(80):
        letters, phones = r.choices("abc", k=r.randint(1, 6)), r.choices("xy", k=r.randint(0, 5))
        model = {(a, b): r.choice([0.25, 0.5]) for a in "abc" for b in ["x", "y", EPSILON]}
        got = AL.best_state(letters, phones, model)
        best = None
        for quiet in itertools.combinations(range(len(letters)), len(letters) - len(phones)) if len(letters) >= len(phones) else ():
            it = iter(phones)
            state = [EPSILON if i in quiet else next(it) for i in range(len(letters))]
            p = math.prod(model[x] for x in zip(letters, state, strict=True))
            if best is None or p > best[0]:
                best = p, state
        assert got == (best and best[1])


def test_one_to_one_em(spark):
    aligned, model = AL.align(L.admissible(lex(spark, CH)).select("word", "letters", "phones"))
    states = {r.word: r.state for r in aligned.collect()}
    assert states["cat"] == ["k", "a", "t"] and len(states["chat"]) == 4
    for total in model.groupBy("letter").agg(F.sum("prob").alias("s")).collect():
        assert abs(total.s - 1) < 1e-9


def test_multigram_em(spark):
    entries = lex(spark, CH)
    q, told = M.fit_units(entries, iterations=12)
    assert all(b >= a - 1e-6 for a, b in zip(told, told[1:], strict=False))
    assert abs(q.agg(F.sum("prob")).first()[0] - 1) < 1e-9
    joins = M.join_candidates(q).orderBy(F.desc("mass")).first()
    assert joins.tokens == "c h"
    report = M.join_report(q).first()
    assert (report.tokens, report.modal_match) == ("c h", "S")
    assert all(len(r.tokens.split()) > len(r.modal_match.split()) for r in M.join_report(q, min_prob=1e-3).collect())
    assert all(len(r.tokens.split()) > len(r.modal_match.split()) for r in M.join_report(q, "phones").collect())
    units = M.nontrivial_units(q, "en_US").collect()
    assert all(len(r.letters) > 1 or len(r.phones) > 1 for r in units) and {r.letters_joined for r in units if r.letters == ["c", "h"]} == {True}
    q, _ = M.fit_units(entries, 2, 1, iterations=12)
    paths = {r.word: r.units for r in M.viterbi(entries, q, 2, 1).collect()}
    assert paths["chat"] == [M.uid(["c", "h"], ["S"]), M.uid(["a"], ["a"]), M.uid(["t"], ["t"])]
    words = spark.createDataFrame([("chap", list("chap")), ("zoo", list("zoo"))], "word string, letters array<string>")
    parts = {r.word: r.segments for r in M.segment(words, q).collect()}
    assert parts["chap"][0] == "c h" and parts["zoo"] is None
    grams = W.ngram_counts(M.viterbi(entries, q, 2, 1).where("units is not null"), F.col("units"))
    found = {r.word: r.predicted for r in M.decode_words(words, q, grams).collect()}
    assert found["chap"] == ["S", "a", "p"] and found["zoo"] is None


def test_expected_counts_against_enumeration():
    q = {M.uid(list(a), list(b)): p for a, b, p in [("a", "x", 0.3), ("ab", "x", 0.2), ("b", "", 0.1), ("b", "y", 0.2), ("ab", "xy", 0.2)]}
    total, counts = M.expected_counts(list("ab"), list("xy"), 2, 2, q)
    assert abs(total - (0.3 * 0.2 + 0.2)) < 1e-12 and abs(counts[M.uid(list("ab"), list("xy"))] - 0.2 / 0.26) < 1e-12
    assert M.expected_counts(list("zz"), list("x"), 2, 2, q) == (0.0, {})


def test_lm_prefers_what_it_saw():
    grams = [("<s>", None, None, 20), ("u", None, None, 20), ("v", None, None, 20), ("</s>", None, None, 20), ("u", "v", None, 20), ("<s>", "u", None, 20)]
    lm = M.NgramModel(grams, 2)
    assert lm.log_prob(("u",), "v") > lm.log_prob(("v",), "u")
    # a history that was seen counts, whether or not the pair was
    assert abs(lm.log_prob(("v",), "u") - math.log(0.01 / (20 + 0.02))) < 1e-12
    assert abs(lm.log_prob(("zz",), "u") - math.log(20.01 / (80 + 0.02))) < 1e-12


@pytest.fixture(scope="module")
def tree(spark):
    entries = L.admissible(lex(spark, CH)).select("word", "letters", "phones")
    aligned, _ = AL.align(entries)
    vectors = W.vector_counts(aligned)
    return aligned, vectors, TR.train(vectors, max_depth=8)


def test_tree_learns_and_round_trips(spark, tree, tmp_path):
    aligned, vectors, nodes = tree
    found = TR.distributions(aligned, nodes)
    rows = found.select("word", "phones", TR.predicted(F.col("dists")).alias("predicted"), TR.confidences(F.col("dists")).alias("c"), TR.nbest(F.col("dists"), 3).alias("n"), "dists").collect()
    assert all(r.phones == r.predicted for r in rows)
    held = TR.walker(nodes)
    for r in rows:
        assert r.n[0].phones == r.predicted and all(a.score >= b.score for a, b in zip(r.n, r.n[1:], strict=False))
        assert [(list(x.phones), x.score) for x in r.n] == held.nbest(list(r.word), 3)
    models.save(str(tmp_path / "en"), {"tree": nodes}, {"width": 7})
    tables, about = models.load(spark, str(tmp_path / "en"))
    again = TR.distributions(aligned, tables["tree"], about["width"]).select("word", TR.predicted(F.col("dists")).alias("p")).collect()
    assert {r.word: r.p for r in again} == {r.word: r.predicted for r in rows}
    assert models.find("en", [str(tmp_path)]) and models.find("xx", [str(tmp_path)]) is None
    assert held.nbest([]) == []


def test_pruning_keeps_a_prefix(spark, tree):
    _, vectors, nodes = tree
    pruned = {r.node: r for r in TR.prune(nodes, vectors).collect()}
    whole = {r.node: r for r in nodes.collect()}
    assert set(pruned) <= set(whole) and 1 in pruned
    for k, r in pruned.items():
        if r.feature is not None:
            assert 2 * k in pruned and 2 * k + 1 in pruned


def test_split_gains_against_plain(spark):
    r = random.Random(3)
    rows = [(1, r.choice("ab"), r.choice("abc"), r.choice("xyz"), r.randint(1, 4)) for _ in range(30)]
    got = {(g.feature, g.value): g.gain for g in TR.split_gains(spark.createDataFrame(rows, "node long, c0 string, c1 string, p string, n long"), ["c0", "c1"]).collect()}

    def entropy(part):
        total, by = sum(x[4] for x in part), {}
        for x in part:
            by[x[3]] = by.get(x[3], 0) + x[4]
        return sum(-v * math.log2(v / total) for v in by.values())

    for (f, v), gain in got.items():
        yes = [x for x in rows if x[1 + f] == v]
        no = [x for x in rows if x[1 + f] != v]
        assert abs(gain - (entropy(rows) - entropy(yes) - entropy(no))) < 1e-6
    assert len(got) == 5


def test_scores(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.0, 1.0],), ([],)], "s array<double>")
    for method, want in (("geometric", 0.5), ("product", 0.25), ("arithmetic", 0.5), ("min", 0.5), ("harmonic", 0.5)):
        assert [round(r[0], 9) for r in df.select(S.combine(F.col("s"), method)).collect()] == [want, 0.0, 0.0]


def test_triage(spark):
    rows = [("of", "AH V", 0.01), ("zhao", "J AW", 0.01), ("mcgee", "M IH G", 0.01), ("mr", "M", 0.02), ("cbs", "S IY B IY EH S", 0.03), ("house", "H", 0.04), ("house", "H AW S", 0.9), ("x", "E", 0.0), ("zero", "Z", 0.0)]
    df = spark.createDataFrame([(w, p.split(), s) for w, p, s in rows], "word string, phones array<string>, score double")
    got = [(r.word, r.category) for r in S.triage_order(S.triage(df)).collect()]
    assert got == [("zero", "ABBREV"), ("mr", "ABBREV"), ("cbs", "ABBREV"), ("mcgee", "FOREIGN"), ("zhao", "FOREIGN"), ("of", "FUNCTION"), ("house", "OK"), ("house", "REVIEW")]
    scored = df.withColumn("phones", F.col("phones"))
    assert [v.pron for v in S.score_variants(scored).where("word = 'house'").first().prons] == ["H AW S", "H"]
    assert [r.word for r in S.select_scored(scored, top=1).collect()] == ["house"] and S.select_scored(scored, threshold=0.015).count() == 5
    assert [r.word for r in S.select_scored(scored, bottom=2).collect()] == ["x", "zero"]


def test_closest_variant(spark):
    rows = [("w", 1, "a b x y z", "a b c"), ("w", 2, "a b", "a b c"), ("v", 1, "q q q q", ""), ("v", 2, "q q q q q", "")]
    df = spark.createDataFrame([(w, k, p.split(), g.split()) for w, k, p, g in rows], "word string, variant int, phones array<string>, predicted array<string>")
    assert {r.word: r.closest for r in E.closest_variant(df).collect()} == {"w": "a b", "v": "q q q q"}
    assert [tuple(r) for r in E.worst_words(df, 1).collect()] == [("v", 5)]


def test_admission_of_long_words(spark):
    df = spark.createDataFrame([(["a"] * n, ["b"] * k) for n, k in ((70, 69), (70, 2), (3, 4), (5, 5), (2, 0))], "letters array<string>, phones array<string>")
    assert sorted(len(r.letters) for r in L.admissible(df, 100).collect()) == [2, 5, 70]
    told = L.alignment_space(df).first()
    assert (told.entries, told.placements, told.too_many) == (5, 70 + 2415 + 1 + 1, False)
    assert L.cooked(df).count() == 4


def test_check_and_usage(spark):
    entries = lex(spark, [("a", "é x"), ("b", "x y")])
    spec = spark.createDataFrame([("é",), ("x",), ("z",)], "phone string")
    assert {(r.phone, r.status) for r in S.check_phones(entries, spec).collect()} == {("é", "form"), ("y", "missing"), ("z", "unused")}
    assert {r.phone: (r.n, r.words) for r in S.phone_usage(entries).collect()}["x"] == (2, ["a", "b"])


def test_metrics_and_split(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "b"], [["a", "b"]]), (["a"], ["e", "f"], [["a"], ["e", "f"]])], "phones array<string>, predicted array<string>, gold array<array<string>>")
    m = E.metrics(rows).first()
    assert (m.n_test, m.wer, m.wer_relaxed, m.per, m.pos_acc) == (2, 50.0, 0.0, 50.0, 50.0)
    words = spark.createDataFrame([(f"w{i}",) for i in range(500)], "word string")
    assert W.split_test(words, max_test=None).where("is_test").count() == 50
    assert W.split_test(words, max_test=7).where("is_test").count() == 7


def test_files(spark, tmp_path):
    (tmp_path / "a").write_text("c h a\tS ∅ a\nbad line\nx\ty z\n")
    aligned = L.parse_alignments(L.read_lines(spark, str(tmp_path / "a")))
    assert [r.value for r in L.render_alignments(aligned).collect()] == ["c h a\tS ∅ a"]
    vectors = spark.createDataFrame([("0 1 2 P",), ("# x",), ("a b c p",), ("a b c p",), ("a b",)], "value string")
    assert [tuple(r) for r in L.parse_vectors(vectors, 3).collect()] == [("a", "b", "c", "p", 2)]
    exc = spark.createDataFrame([(0, "A\tx y"), (1, "a\tz"), (2, "# c"), (3, "bad")], "seq int, value string")
    assert [tuple(r) for r in L.parse_exceptions(exc).collect()] == [("a", ["z"])]
    scored = spark.createDataFrame([("w", 3, {"x": 0.25, "y": 1.0})], "word string, freq long, prons map<string,double>")
    L.write_scored(scored, str(tmp_path / "s"))
    assert L.read_scored(spark, str(tmp_path / "s")).first().prons == {"x": 0.25, "y": 1.0}
    assert models.read_config("fast", PRESETS)["width"] == 5 and PRESETS["pocketsphinx"]["phoneset"] == "cmu"
    for ending in ("json", "toml", "yaml"):
        models.write_config({"width": 3, "criterion": "gini", "cased": True, "x": 0.5, "joins": [1, 2]}, str(tmp_path / f"c.{ending}"))
        told = models.read_config(str(tmp_path / f"c.{ending}"), PRESETS)
        assert (told["width"], told["criterion"], told["cased"], told["x"], told["joins"], told["iterations"]) == (3, "gini", True, 0.5, [1, 2], 15)
    log = spark.createDataFrame([("W toomany: word 1234",), ("other",)], "value string")
    assert [tuple(r) for r in L.parse_aligner_log(log).collect()] == [("word", 1234.0)]
    counted = spark.createDataFrame([("a", "b", "c", "p", 2)], "c0 string, c1 string, c2 string, p string, n long")
    assert [r.value for r in L.render_vectors(counted).collect()] == ["0 1 2 P", "a b c p", "a b c p"]
    triaged = S.triage(spark.createDataFrame([("house", ["H"], 0.01), ("of", ["V"], 0.02)], "word string, phones array<string>, score double"))
    L.write_triage(triaged, str(tmp_path / "t"))
    assert {r.category: r._c1 for r in spark.read.csv(str(tmp_path / "t"), sep="\t").collect()} == {"REVIEW": "house", "FUNCTION": "of"}
    L.write_joins({"letters": spark.createDataFrame([("c h", 0.5)], "tokens string, total_mass double")}, {"n": 1}, str(tmp_path / "j"))
    assert '"c h"' in (tmp_path / "j").read_text()
    assert L.write_manifest(str(tmp_path / "m"), name="x", n=3)["n"] == 3


def test_stream_is_the_batch(spark, tree, tmp_path):
    from lexiloom.streaming.pronounce import pronounce, render, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("Chat, cat!\nmuch\n")
    nodes = tree[2]
    stream = render(pronounce(text_stream(spark, str(tmp_path / "in")), nodes))
    run = stream.writeStream.format("memory").queryName("said").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    batch = render(pronounce(spark.read.text(str(tmp_path / "in")), nodes))
    assert sorted(r.value for r in spark.table("said").collect()) == sorted(r.value for r in batch.collect())


@pytest.fixture(scope="module")
def pronouncer(spark):
    from lexiloom.api import Pronouncer

    entries = lex(spark, [*CH, ("cat", "k e t")]).withColumn("variant", F.when(F.col("seq") == 10, 2).otherwise(1))
    return Pronouncer.train(entries.select("word", "phones", "variant"), preset=PRESETS["defaults"] | {"max_depth": 6})


def test_pronouncer(spark, pronouncer, tmp_path):
    from lexiloom.api import Pronouncer

    words = spark.createDataFrame([("Cat",), ("chap",), ("c5p",), ("cp",), ("ß",), ("",)], "word string")
    got = {r.word: (list(r.phones), list(r.confidences)) for r in pronouncer.pronounce(words).collect()}
    assert got["Cat"] == (["k", "a", "t"], [1.0] * 3) and got["c5p"] == got["cp"] and got["ß"][0] == [] == got[""][0]
    assert all(pronouncer(w) == got[w][0] for w in got)
    scored = {r.word: r for r in pronouncer.score(spark.createDataFrame([("much", ["m", "a", "S"]), ("much", ["z"])], "word string, phones array<string>")).collect()}
    assert scored["much"].score in (0.0, 1.0) or scored["much"].flag in "=!"
    assert pronouncer.nbest(words, 2).where("word = 'chap'").first().nbest[0].score > 0
    pronouncer.save(str(tmp_path / "m"))
    again = Pronouncer.load(spark, str(tmp_path / "m"))
    assert all(again(w) == pronouncer(w) for w in ("cat", "chap"))


def test_joined_tokens_share_a_confidence(spark):
    df = spark.createDataFrame([([[("k₊s", 0.75), ("k", 0.25)], [(EPSILON, 1.0)], [("a", 0.5)]],)], "d array<array<struct<phone:string,prob:double>>>")
    assert df.select(TR.confidences(F.col("d")), TR.predicted(F.col("d"))).first()[:] == ([0.75, 0.75, 0.5], ["k", "s", "a"])


def test_harness(spark):
    from lexiloom.operators import harness as H

    entries = lex(spark, CH).select("word", "phones")
    small = {"max_depth": 3}
    split = {"max_test": 2, "fraction": 0.2}
    both = H.compare_locales({"en_US": entries, "default": entries}, small, order=2, iterations=3, **split).collect()
    assert {r.locale for r in both} == {"en_US", "default"} and all(r.winner in ("one", "many", "tie") for r in both)
    grid = H.sweep(entries, [(2, 1)], [1, 2], iterations=3, **split).collect()
    assert sorted(r.lm_order for r in grid) == [1, 2] and all(r.n_test == 2 for r in grid)
    told = H.policy_experiments(entries, "it_IT", ["identity", "collapse_open"], small, **split).collect()
    assert [(r.policy, r.changed_entries) for r in told] == [("identity", 0), ("collapse_open", 0)]
    train, test = H.held_out(entries, **split)
    assert train.count() == 8 and test.count() == 2
    model = H.train_units(train, iterations=2)
    assert model.skipped == 0 and len(model.log_likelihoods) == 2
    assert H.benchmark(model, test)["words"] == 2
    assert H.markdown(spark.createDataFrame([(1, None)], "a int, b string"), "t").splitlines()[-1] == "| 1 |  |"
