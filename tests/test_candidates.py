import pytest
from pyspark.sql import functions as F

from kataflow.functions import rules
from kataflow.operators import candidates as C

# Tokens with all their hits, in order, among WORDS.
TRACES = """
dirikan, dirikan, merikan, diri, rik, ri, dir, mengerik, r
berikan, berikan, ikan, beri, berik, rik, i, ik
diberikan, diberikan, memberikan, berikan, diberi, ikan, beri, berik, memberi, rik, i, ik
pemberian, pemberian, berian, pemberi, rian, ian, beri, i
mengunyah, mengunyah, kunyah, nyah, mengesah, cah, sah
menggali, menggali, gali, gal
mengali, mengali, ali, kali, mengekali, kal, al
menyapu, menyapu, sapu, apu
meraba, meraba, raba
"""


def texts(token):
    return [r[2] for r in C.candidates(token)]


@pytest.mark.parametrize("line", TRACES.split("\n")[1:-1])
def test_traces(line):
    token, *hits = line.split(", ")
    own = set(hits)
    assert [t for t in texts(token) if t in own] == hits


def test_catalogue():
    assert len(rules.RULES) == 109 and len(rules.TRANSFORMS) == 17
    assert {g for g, _, _, r in rules.RULES if r.condition} == set(range(7, 36)) - {34} | {34}


def test_order_and_ranks():
    # What these words become first.
    assert texts("diselesaikan")[:3] == ["diselesaikan", "menyelesaikan", "selesaikan"]
    assert texts("gara2").index("gara-gara") < texts("gara2").index("gara")
    assert "" in texts("di")
    rows = C.candidates("memberitahukannya")
    assert [r[1] for r in rows] == list(range(1, len(rows) + 1)) and len({r[2] for r in rows}) == len(rows)
    assert C.variants("Diselesaikan") == [("Diselesaikan", []), ("diselesaikan", ["decapitalize"])] and "menyelesaikan" in texts("Diselesaikan")
    assert all(r[5] in (0, 1) for r in rows)


def brute(text):
    """Breadth first without pruning: every chain, the guard being that a frame (rule, text) doesn't come twice."""
    queue, out = [(text, 0, ())], []
    while queue:
        s, conditions, trace = queue.pop(0)
        out.append((s, trace))
        if conditions:
            continue
        for g, _, emitted, f in rules.program():
            if (g, s) not in trace and (made := f(s)) is not None:
                queue.append((made, emitted, (*trace, (g, s))))
    seen, first = set(), []
    for s, _ in out:
        if s not in seen:
            seen.add(s)
            first.append(s)
    return first


@pytest.mark.parametrize("word", ["diselesaikan", "nyari2in", "ngebangunin", "keberhasilannyalah", "ga-apa", "menemen", "berlari-lari", "kutemukan", "n2", "terin", "mengemen"])
def test_pruning_keeps_the_order(word):
    assert [r[0] for r in dict.fromkeys((x[0],) for x in C.rewrite(word))] == brute(word)


def test_variants_in_columns(spark):
    words = ["Diselesaikan", "ÉCOLE", "ßa", "abc", "Ǆx", "1a"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    found = {r.token: [(v.text, list(v.preprocessors)) for v in r.variants] for r in C.with_variants(df).collect()}
    assert found == {w: C.variants(w) for w in words}
    twice = spark.createDataFrame([("É", 1), ("É", 1), (None, 2)], "token string, n int")
    assert sorted((r.token or "", r.n, len(r.variants or ())) for r in C.with_variants(twice).collect()) == [("", 2, 0), ("É", 1, 4), ("É", 1, 4)]


def test_columns_agree_with_python(spark):
    words = ["dirikan", "nyariin", "ngopi", "memperbaiki", "belajar", "menemen", "ketidakadilan", "gak", "lari-lari", "berlari-larian", "gara2", "kebaikan", "din", "ketidakan", "perbaiki", "XYZin", ""]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r.token: [(x.g, x.text, x.conditions) for x in r.s] for r in df.select("token", rules.steps(F.col("token")).alias("s")).collect()}
    assert got == {w: [(g, m, c) for g, _, c, f in rules.program() if (m := f(w)) is not None] for w in words}
    made = {r.token: [] for r in df.collect()}
    for r in C.generate(df).orderBy("token", "rank").collect():
        made[r.token].append(r.text)
    assert made == {w: texts(w) for w in words}


def test_flags():
    flags = C.ConditionFlags({"v": None, "n": None, "any": ("v", "n")}, frozenset({"v"}))
    assert flags.of(["any"]) == 3 and flags.of(["x", "n"]) == 2 and flags.of_word_classes(["n", "v"]) == 1
    with pytest.raises(ValueError, match="unknown"):
        flags.of(["x"], strict=True)
    with pytest.raises(ValueError, match="cyclic"):
        C.ConditionFlags({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError, match="more than"):
        C.ConditionFlags({f"c{i}": None for i in range(33)})
