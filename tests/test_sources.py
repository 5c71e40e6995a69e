import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.operators import codecs, sequences
from glyphloom.plans.models import syllables
from glyphloom.sources import markup, sinks, transcription
from glyphloom.streaming import events

# Literal samples of the format and what they are read as.
PAGES = """<f1r> <! $H=1 $L=A $I=H>
<f1r.1,@P0> <%>daiin.chol
<f1r.2,+P0> or.dal<$>
<f1r.3,*P0> <%>shol.chor<@H=2>
<f1r.4,=Pt> chol<$>
<f1r.5,+P0> daiin.chol
<f1v> <! $H=1 $L=B>
<f1v.1,@P0> <%>daiin.?.chol<->or,y<$>
"""


def body(spark, text):
    words, gaps = transcription.body_words(F.col("b"))
    r = spark.createDataFrame([(text,)], "b string").select(words.alias("w"), gaps.alias("g"), transcription.lossy_tokens(F.col("b")).alias("t"), transcription.lossy_tokens(F.col("b"), True).alias("f")).first()
    return r


def test_bodies(spark):
    r = body(spark, "<%>daiin.?.chol<->or,y<$>")
    assert [w["word"] for w in r["w"]] == ["daiin", "?", "chol", "or", "y"]
    assert [w["clean"] for w in r["w"]] == [True, False, True, True, True]
    assert r["g"] == ["ordinary", "ordinary", "drawing", "uncertain"]
    r = body(spark, "dai<!annotation>in.dai[{cto}:@194;]y")
    assert [tuple(w) for w in r["w"]] == [("daiin", True), ("daictoy", False)]
    r = body(spark, "dai[{cto}:@194;]y")
    assert (r["t"], r["f"]) == (["daicto", "y"], ["daictoy"])
    r = body(spark, "daiiir[{ih}:ch]y")
    assert (r["t"], r["f"]) == (["daiiirihchy"], ["daiiirihy"])
    r = body(spark, "da[n:r].cheo")
    assert (r["t"], r["f"]) == (["dan", "cheo"], ["dan", "cheo"])


def test_pages(spark, tmp_path):
    (tmp_path / "pages.txt").write_text(PAGES)
    rows = {r["locus"]: r for r in transcription.read_lines(spark, str(tmp_path / "pages.txt")).collect()}
    assert sorted(rows) == ["f1r.1", "f1r.2", "f1r.3", "f1r.5", "f1v.1"]
    assert {r["folio"] for r in rows.values()} == {"f1"}
    assert [rows[x]["meta"]["H"] for x in ("f1r.1", "f1r.2", "f1r.3", "f1r.5", "f1v.1")] == ["1", "1", "2", "2", "1"]
    assert rows["f1r.5"]["meta"]["L"] == "A" and rows["f1v.1"]["meta"]["L"] == "B"
    assert rows["f1r.1"]["paragraph_start"] and not rows["f1r.1"]["paragraph_end"] and rows["f1r.2"]["paragraph_end"]
    assert transcription.read_lines(spark, str(tmp_path / "pages.txt"), None).count() == transcription.read_lines(spark, str(tmp_path / "pages.txt"), "P").count() == 6


def test_records(spark, tmp_path):
    words, gaps, end = transcription.record_words(F.col("b"))
    r = spark.createDataFrame([("fa19s.9,hae.A*am.2oe=\r\n",)], "b string").select(words.alias("w"), gaps.alias("g"), end.alias("e")).first()
    assert [w["word"] for w in r["w"]] == ["fa19s", "9", "hae", "A*am", "2oe"] and [w["clean"] for w in r["w"]] == [True, True, True, False, True]
    assert (r["g"], r["e"]) == (["ordinary", "uncertain", "ordinary", "ordinary"], "=")
    names = ["1r", "67r1", "rose", "101r1-r2", "101v2-v1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(transcription.record_page(F.col("n")).alias("p")).collect()
    assert [x["p"] for x in got] == ["f1r", "f67r1", "fRos", "f101r", "f101v"]
    (tmp_path / "r.txt").write_bytes("<1r.1>fa\xe9.9-\r\n<1r.2>am=\r\n<1r.ring>x=\r\n<1r.3>8am-\r\n<rose.4>o-\r\n".encode("latin-1"))
    rows = {r["locus"]: r for r in transcription.read_records(spark, str(tmp_path / "r.txt")).collect()}
    assert [(k, rows[k]["kind"], rows[k]["paragraph_start"], rows[k]["paragraph_end"]) for k in ("f1r.1", "f1r.2", "f1r.ring", "f1r.3", "fRos.4")] == [("f1r.1", "text", True, False), ("f1r.2", "text", False, True), ("f1r.ring", "label", False, False), ("f1r.3", "text", True, False), ("fRos.4", "text", True, False)]
    assert rows["f1r.1"]["words"][0]["word"] == "faé" and rows["fRos.4"]["folio"] == "fRos"
    counts = transcription.page_counts(transcription.read_records(spark, str(tmp_path / "r.txt"))).where("page = 'f1r'").first()
    assert (counts["lines"], counts["kept"], counts["left_out"]) == (4, 5, 0)


def test_neighbours(spark, tmp_path):
    (tmp_path / "p.txt").write_text("<f1r> <! $H=1>\n<f1r.1,@P0> dain.chol<->dar.qokain,shedy.dal\n")
    lines = transcription.read_lines(spark, str(tmp_path / "p.txt"))
    plain = [(r["word"], r["next"]) for r in transcription.neighbours(lines).orderBy("pos").collect()]
    assert plain == [("dain", "chol"), ("chol", None), ("dar", "qokain"), ("qokain", "shedy"), ("shedy", "dal"), ("dal", None)]
    one = [(r["word"], r["next"]) for r in transcription.neighbours(lines, True).orderBy("pos").collect()]
    assert one == [("dain", "chol"), ("chol", None), ("dar", "qokainshedy"), ("qokainshedy", "dal"), ("dal", None)]


def test_markup(spark):
    pages = spark.createDataFrame([(1, "<p>one <b>two</b></p><p class='center'>no</p><p>three<br>four<span class='pagenum'>9</span> five</p>"), (2, None)], "page_id long, html string")
    got = [(r["page_id"], r["paragraph"], r["text"]) for r in markup.html_paragraphs(pages).collect()]
    assert got == [(1, 0, "one two"), (1, 1, ""), (1, 2, "three four five")]
    xml = spark.createDataFrame([(1, "<a>x <note>no</note>tail <b>y</b></a>")], "k long, x string")
    assert markup.xml_text(xml, "k", "x").first()["text"] == "x tail y"
    box = spark.createDataFrame([('[[["ab",2,"p",[1]],["cd",1,"p",[2]]],[[1,5,6,7,8],[0,1,2,3,4]]]',)], "value string")
    assert [tuple(r) for r in markup.boxes(box).collect()] == [(0, "cd", 5, 6, 7, 8), (1, "ab", 1, 2, 3, 4)]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    sinks.write_csv([a, b], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["d", "i", "s"]
    h = sinks.write_json(str(tmp_path / "v.json"), {"b": 1, "a": [2]})
    assert sinks.read_json(str(tmp_path / "v.json"), h) == {"a": [2], "b": 1}
    with pytest.raises(FileExistsError):
        sinks.write_json(str(tmp_path / "v.json"), 1)
    with pytest.raises(ValueError):
        sinks.read_json(str(tmp_path / "v.json"), "0")
    with pytest.raises(ValueError):
        sinks.canonical_json(float("nan"))


def test_registry(spark, tmp_path):
    r = events.Registry(spark, str(tmp_path / "lab"))
    run = r.register("keys", {"seed": 1})
    with pytest.raises(ValueError):
        r.register("keys", {"seed": 1})
    again = r.register("keys", {"seed": 1}, "checked anew")
    assert again != run and r.list("keys").count() == 2 and r.list("other").count() == 0
    assert r.specifications().count() == 1
    rows = spark.createDataFrame([(0, "c", 1.0), (1, "d", 2.0)], "sequence long, candidate_id string, loss double")
    assert r.commit(run, 0, rows)
    assert not r.commit(run, 0, rows)  # written again after a failure
    assert r.commit(again, 0, rows)  # another run's first batch
    assert r.attempts().count() == 4 and {(x["run_id"], x["batch"]) for x in r.attempts().collect()} == {(run, 0), (again, 0)}
    for first, batch in ((5, 1), (2, 2), (1, 1)):  # a gap, a batch too far, a sequence that is there
        with pytest.raises(ValueError):
            r.commit(run, batch, spark.createDataFrame([(first, "e", 1.0)], "sequence long, candidate_id string, loss double"))
    with pytest.raises(ValueError):
        r.commit("none", 0, rows)
    assert r.commit(run, 1, spark.createDataFrame([(2, "e", 0.5), (3, "c", 0.1)], "sequence long, candidate_id string, loss double"))
    kept = events.retained(r.attempts().where(F.col("run_id") == run), 2, 5).collect()
    assert [(k["candidate_id"], k["loss"], k["tries"]) for k in kept if k["kept"] == "top"] == [("c", 0.1, 2), ("e", 0.5, 1)] and [k["candidate_id"] for k in kept if k["kept"] == "reservoir"] == ["d"]
    with r._locked(), pytest.raises(TimeoutError):
        events.Registry(spark, str(tmp_path / "lab"), 0.2).record(run, "running")
    assert len(r.import_legacy("old", [{"manifest": {"k": 1}, "losses": [("a", 1.0), ("b", 2.0)]}])) == 1 and r.list("old").count() == 1
    assert r.get(r.specifications().first()["spec_id"]) == {"seed": 1}


class Walk:
    """A random walk over numbers that goes on from the best."""

    def __init__(self):
        self.rng, self.best = np.random.default_rng(3), (9e9, 50)

    def propose(self, n):
        return [str(int(self.best[1] + self.rng.integers(-9, 10))) for _ in range(n)]

    def observe(self, losses):
        self.best = min([self.best, *((l, int(c)) for c, l in losses)])

    def snapshot(self):
        return {"rng": self.rng.bit_generator.state, "best": list(self.best)}

    def restore(self, s):
        self.rng.bit_generator.state, self.best = s["rng"], tuple(s["best"])


def test_runner_resumes_as_if_unbroken(spark, tmp_path):
    evaluate = lambda rows: rows.withColumn("loss", F.abs(F.col("candidate_id").cast("double") - 7.25))
    found = []
    for name, pauses in (("whole", (None,)), ("broken", (1, 2, None))):
        r = events.Registry(spark, str(tmp_path / name))
        run = r.register("walk", {"seed": 3})
        for p in pauses:
            why = events.run_search(r, run, Walk(), evaluate, 22, batch=5, pause_after=p)
        assert why == "evaluations" and events.run_search(r, run, Walk(), evaluate, 22, batch=5) == "evaluations"
        found.append(sorted((a["sequence"], a["batch"], a["candidate_id"], a["loss"]) for a in r.attempts().collect()))
    assert found[0] == found[1] and len(found[0]) == 22
    r = events.Registry(spark, str(tmp_path / "slow"))
    assert events.run_search(r, r.register("walk", {}), Walk(), evaluate, 22, seconds=-1.0) == "time"


def test_paged_permutations(spark):
    from glyphloom.operators import resampling

    rng = np.random.default_rng(5)
    rows = [(p, i, "abc"[x], "xyz"[x if rng.random() < 0.3 else rng.integers(3)]) for p in range(5) for i in range(200) for x in [int(rng.integers(3))]]
    pairs = spark.createDataFrame(rows, "page int, pos int, a string, b string")
    one, two = (sorted(map(tuple, resampling.paged_permutations(x, 50, "page").collect())) for x in (pairs, pairs.repartition(7)))
    assert one == two
    for page in (0, None):  # letters are kept, page by page and in all
        part = pairs if page is None else pairs.where(F.col("page") == page)
        for r in (0, 1, 50):
            sums = {}
            for rep, a, b, n in resampling.paged_permutations(part, 50, "page").collect():
                if rep == r:
                    sums[b] = sums.get(b, 0) + n
            assert sums == {x: n for x, n in ((ord(k["b"]) - 97, k["count"]) for k in part.groupBy("b").count().collect())}
    fast, slow = resampling.paged_permutation_test(pairs, 199, "page").first(), resampling.permutation_test(pairs, 40, ("page",)).first()
    assert fast["observed"] == pytest.approx(slow["observed"]) and fast["p"] == 1 / 200 and fast["null_mean"] == pytest.approx(slow["null_mean"], rel=0.4)


def test_functions(spark):
    df = spark.createDataFrame([("chckhy",), ("qoteedy",), ("a",)], "w string")
    rows = df.select(T.glyphs(F.col("w")).alias("g"), T.stem(F.col("w")).alias("s"), T.stem_family(F.col("w")).alias("f"), T.cuts(F.col("w")).alias("c"), syllables(F.col("w")).alias("y")).collect()
    assert rows[0]["g"] == ["ch", "ckh", "y"] and rows[0]["s"] == "chckh"
    assert rows[1]["f"] == "tedy" and rows[2]["c"] == [] and rows[2]["s"] == ""

    def parts(word):
        out, at = [], 0
        for i in range(1, len(word)):
            before = any(c in "aeiou" for c in word[:i])
            if before and (word[i] in "aeiou" and word[i - 1] in "aeiou" or word[i] not in "aeiou" and i + 1 < len(word) and word[i + 1] in "aeiou"):
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    words = ["constantia", "aeiou", "strength", "a", "bcd", "ouble", "tionand", "instar"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", syllables(F.col("w")).alias("y")).collect()
    assert {r["w"]: r["y"] for r in got} == {w: parts(w) for w in words}


def test_sequences():
    assert sequences.align("abcd", "abd")[1] == [(0, 0), (1, 1), (3, 2)]
    assert sequences.align("", "ab")[0] == -2
    assert sequences.segment("theman", {"the": 3.0, "man": 4.0, "them": 9.0, "an": 3.0}, 30.0, 4) == ["the", "man"]
    pairs = [(w.replace("th", "9"), w) for w in ["the", "that", "hat", "eat", "tea", "heat", "theta", "ate"]] * 3
    learned = sequences.learn_aligner(pairs)
    assert learned["9"] == "th" and learned["a"] == "a"
    table = np.outer([0.5, 0.3, 0.2], [0.6, 0.4]) * 100
    assert np.isclose(sequences.product_model(table)[3], (table * np.log2(table / 100)).sum())
    assert codecs.trie_decode("0100", {"0": "a", "10": "b"}) == ["a", "b", "a"]
    assert sorted(codecs.readings("aab", {"a": ["x"], "aa": ["y"], "b": ["z"]})) == ["xxz", "yz"]
    d = np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0.0]])
    assert sequences.average_linkage(d, 2).tolist() == [0, 0, 1]


def test_permutations_by_page_and_by_window(spark):
    from glyphloom.operators import resampling

    rows = [(p, i, "ab"[(p + i) % 2], "xyz"[(i * i + p) % 3]) for p in range(4) for i in range(30)]
    pairs = spark.createDataFrame(rows, "page int, pos int, a string, b string")
    one, two = (sorted(tuple(r) for r in resampling.permuted_cells(pairs, 3, ("page",), paged=p).collect()) for p in (True, False))
    assert one == two and sum(r[-1] for r in one) == 3 * len(rows)
