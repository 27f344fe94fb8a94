"""Text rules, language functions, checks and sanitizers on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from cueforge.functions import checks as K
from cueforge.functions import text as X
from cueforge.operators import cues as C
from cueforge.operators import structure as S


def values(spark, cases, *columns):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in "ab"[: len(cases[0])]))
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in rows.orderBy("i").select(*columns).collect()]


CLEAN = [
    ("Hello , world", "Hello, world"),
    ("wait !? !", "wait!?!"),
    ("see .gitignore and ./script.sh", "see .gitignore and ./script.sh"),
    ("1 .5 stays", "1 .5 stays"),
    ("end ....", "end..."),
    ("../README is a path", "../README is a path"),
    ("a,b", "a, b"),
    ("é,b", "é, b"),
    ("<i>Hi</i> &amp; bye", "Hi & bye"),
    ("&amp;lt;", "&lt;"),
    ("“quoted” ‘x’ …", "\"quoted\" 'x'..."),
    ("a​b c", "ab c"),
    ("x\ty  z", "x y z"),
    ("keep [? this , one ?] now , ok", "keep [? this , one ?] now, ok"),
    ("", ""),
    (None, None),
]


def test_cue_text(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, text string")
    got = [r.text for r in C.clean_text(rows).orderBy("i").collect()]
    assert got == [b for _, b in CLEAN]
    # a trace gives the same text, and cleaning twice changes nothing
    traced = C.clean_text(rows, steps="steps").orderBy("i").collect()
    assert [r.text for r in traced] == got
    assert {h.rule_id for h in traced[8].steps} == {"C10", "C6"}
    again = C.clean_text(C.clean_text(rows)).orderBy("i").collect()
    assert [r.text for r in again][:9] == got[:9] and [r.text for r in again][10:] == got[10:]  # only an entity of an entity changes again


def test_content_survives_cleaning(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, text string").where("i <> 9")
    before = {r.i: r.k for r in rows.select("i", X.content_key(F.col("text")).alias("k")).collect()}
    after = {r.i: r.k for r in C.clean_text(rows).select("i", X.content_key(F.col("text")).alias("k")).collect()}
    assert before == after


def test_language(spark):
    a = F.col("a")
    assert values(spark, [("English",), (" zh-CN ",), ("klingon",)], X.language_code(a)) == ["en", "zh", None]
    assert values(spark, [("hello there",), ("你好世界",), ("こんにちは",), ("안녕하세요",), ("",), (None,)], X.detect_language(a)) == ["en", "zh", "ja", "ko", "en", "en"]


def test_tokens(spark):
    assert values(spark, [("Hello , big  world !",), ("",), (None,)], X.tokenize(F.col("a"))) == [["Hello,", "big", "world!"], [], []]
    joined = spark.range(1).select(X.join_tokens(F.array(*[F.lit(x) for x in ["He", "said", '"', "go", '"', ",", "(", "now", ")"]]))).first()[0]
    assert joined == 'He said "go", (now)'


def test_pairs(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, [("Hello world", "hello, world."), ("a b", "a c")], X.punctuation_only_change(a, b)) == [True, False]
    assert values(spark, [("it is ok.", "It is ok!"), ("no end", "no end.")], X.keep_trailing(a, b)) == ["It is ok.", "no end."]
    assert values(spark, [("see node.js now", "see Node. js, now")], X.protect_dotted(a, b)) == ["see node.js, now"]
    moved = X.transfer_punctuation(X.white_split(a), X.white_split(b))
    assert values(spark, [("a b", '"x, y!'), ("a", "x y")], moved) == [['"a,', "b!"], None]


def test_replies(spark):
    a = F.col("a")
    assert values(spark, [("<think>x</think>`ok`",), ("<think>open",)], X.clean_reply(a)) == ["ok", ""]
    assert values(spark, [('said {"terms": {" a ": "b", "": "c", "d": " "}} end',), ("none",)], X.parse_terms(a)) == [{"a": "b"}, None]
    assert values(spark, [('```json\n[{"tgt": "x"}, {"zh": "y"},]\n```',)], X.parse_mapping(a)) == [["x", "y"]]
    assert values(spark, [("\n one \n\n two\nthree",)], X.parse_lines(a)) == [["one", "two"]]


def test_small_functions(spark):
    a = F.col("a")
    assert values(spark, [("x",), ("hello",)], X.capitalize(a)) == ["x", "Hello"]
    assert values(spark, [("ep10",), ("ep2",)], X.natural_key(a)) > values(spark, [("ep2",), ("ep10",)], X.natural_key(a))
    assert values(spark, [("Well, fine",), ("Well, ",)], X.strip_prefix(a, {"well,": "嗯，"})[0]) == ["fine", "Well, "]
    assert spark.range(1).select(X.srt_time(F.lit(3_723_004))).first()[0] == "01:02:03,004"
    assert spark.range(1).select(X.split_candidates(F.array(F.lit("aaaa."), F.lit("bb"), F.lit("cc")))).first()[0] == [1, 2]
    assert spark.range(1).select(F.round(X.cross_ratio(F.lit(1), F.lit(2), F.lit(2), F.lit(1)), 3)).first()[0] == 4.0


def test_sanitizers(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, [("```x```", ""), ("“‘a’”", "")], X.strip_quotes(X.strip_backticks(a, b), b)) == ["x", "a"]
    assert values(spark, [("好（注：说明）。", ""), ("好", "")], X.strip_annotation(a, b)) == ["好", "好"]
    assert values(spark, [("好：", "fine."), ("好：", "fine")], X.colon_as_source(a, b)) == ["好。", "好："]
    assert values(spark, [("，。 好", "")], X.strip_leading(a, b)) == ["好"]


PAIRS = [
    ("Hello", "", ["non_empty"]),
    ("Hello", "x" * 250, ["length_abs_max"]),
    ("A rather long source text", "a", ["length_short_target"]),
    ("Hi", "x" * 11, ["length_ratio"]),
    ("Hello there", "Sure, hello", ["format_hallucination"]),
    ("Is it?", "yes it is", ["question_mark"]),
    ("Fine", "the translation is x", ["keyword_forbidden", "keyword_inconsistency"]),
    ("Hello there you", "Hello there you", []),
]


def test_checks(spark):
    scene = K.pair_scene("fr", "en")
    rows = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(PAIRS)], "i int, src string, tgt string").withColumns({"prompt_tokens": F.lit(None).cast("int"), "completion_tokens": F.lit(None).cast("int")})
    got = rows.select("i", K.run_scene(scene, F.col("src"), F.col("tgt")).alias("x")).orderBy("i").collect()
    assert [[h.rule for h in r.x] for r in got] == [w for _, _, w in PAIRS]


def test_scenes():
    assert [r[1] for r in K.resolve_scene("translate.lenient")["rules"]][:3] == ["error", "warning", "warning"]
    with pytest.raises(ValueError, match="extend"):
        K.resolve_scene("a", {"a": {"extends": ["b"]}, "b": {"extends": ["a"]}})
    off = K.resolve_scene("x", {"x": {"extends": ["subtitle.line"], "disable": ["non_empty"]}})
    assert off["rules"] == []


def test_structure(spark):
    text = 'Dr. Smith came. He said "go." Then U.S.A. won... and left! J. Doe stayed'
    rows = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    assert rows.select(S.split_sentences(t)).first()[0] == ["Dr. Smith came.", 'He said "go."', "Then U.S.A. won... and left!", "J. Doe stayed"]
    chunks = rows.select(S.split_by_length(t, 20)).first()[0]
    assert all(len(c) <= 20 for c in chunks) and " ".join(chunks) == text
    assert rows.select(S.merge_to_length(F.array(F.lit("a"), F.lit("b"), F.lit("cccc")), 4)).first()[0] == ["a b", "cccc"]
    long = spark.createDataFrame([("one two three four five because six seven eight nine ten eleven",)], "t string")
    assert long.select(S.at_connectives(t)).first()[0] == ["one two three four five", "because six seven eight nine ten eleven"]
    assert long.select(S.at_connectives(F.lit("short because so"))).first()[0] == ["short because so"]
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            S.fill_to_length(t, bad)


def test_cascade_and_cache(spark):
    rows = spark.createDataFrame([(1, "aa bb cc. dd ee ff."), (2, "x"), (3, None), (4, "aa bb cc. dd ee ff.")], "id int, t string")
    out = S.cascade(rows, "t", 9, [S.split_sentences, lambda c: S.split_by_length(c, 5)])
    got = {}
    for r in out.orderBy("id", "path").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got == {1: ["aa bb cc.", "dd ee ff."], 2: ["x"], 3: [None], 4: ["aa bb cc.", "dd ee ff."]}
    cache = spark.createDataFrame([("x", ["cached"])], "text string, result array<string>")
    done, grown = S.cached_transform(rows, "t", cache, lambda d: d.select("text", F.array(F.upper("text")).alias("result")))
    assert sorted(r.out for r in done.collect()) == ["AA BB CC. DD EE FF.", "AA BB CC. DD EE FF.", "cached"]
    assert grown.count() == 2


def test_sanitized_files_keep_fences(spark):
    df = spark.createDataFrame([("a  b [?x  <i>y</i>..?] c..d\r\n<b>e</b> &amp;",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(X.sanitize_file(F.col("t"))).collect()]
    assert got == ["a b [?x  <i>y</i>..?] c.d\ne &", None, ""]


def test_content_keys_of_compatible_forms(spark):
    df = spark.createDataFrame([("\ufb01ne \u2460",), ("fine 1",), ("f\u200bine, <i>1</i>\x7f",), ("&#xfb01;ne1",)], "t string")
    assert {r[0] for r in df.select(X.content_key(F.col("t"))).collect()} == {"fine1"}


def test_clean_cue_paths(spark):
    texts = ["plain", "a  b ,c", "\x7fde\x00l\t x", " “q” … ..", "&lt;i&gt;x [?a  b?] y  z", "[!only!]", "x\u3000y\u200b", "", None, "a....b c..", "<b>t</b> .. &amp;amp;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(c):
        for _, rule in X.CUE_RULES:
            c = rule(c)
        return c

    masked, spans = X.mask_fences(F.col("t"))
    for got, want in df.select(X.clean_cue(F.col("t")), X.unmask_fences(plain(masked), spans)).collect():
        assert got == want


@pytest.mark.parametrize("text", ["see ⟦0⟧ and [? a  ?] now", "x [? has ⟦1⟧ ?] y [! b ?] <i> !] z", "⟦1⟧ [? a ?] ⟦ [? b ?] ⟧0⟦", "[? ⟦0⟧ ?][! ⟦1⟧ !]"])
def test_marks_of_fences_in_the_text(spark, text):
    """What looks like a mark stays, whatever rules run between the fences."""
    df = spark.createDataFrame([(text, "no fence ⟦0⟧")], "t string, u string")
    masked = X.mask_fences(F.col("t"))
    got = df.select(X.clean_cue(F.col("t")), X.sanitize_file(F.col("t")), X.unmask_fences(*masked), X.clean_cue(F.col("u"))).first()
    assert list(got) == [text, text, text, "no fence ⟦0⟧"]


def test_marks_before_a_closing_quote(spark):
    said = [["He", "said", '"', "hi", "!", '"'], ['"', "a", "-", '"', "b", "!"], ["x", "!", '"', "y", '"']]
    got = spark.createDataFrame([(t,) for t in said], "t array<string>").select(X.join_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == ['He said "hi!"', '"a-" b !', 'x ! "y"']


def test_english_openings_in_chinese(spark):
    said = ["Okay. So it goes", " ok... fine", "OK, ", "um,what", "Uh, huh", "okay then", None]
    rest, prefix = X.strip_prefix(F.col("t"))
    got = spark.createDataFrame([(t,) for t in said], "t string").select(rest, prefix).collect()
    assert [tuple(r) for r in got] == [("So it goes", "好的。"), ("fine", "好的。"), ("OK, ", None), ("what", "嗯，"), ("huh", "呃，"), ("okay then", None), (None, None)]


def test_east_asian_joins():
    from cueforge.functions import cjk

    assert cjk.join_of(["저", "는", " ", "학교", "에", " ", "갔", "다", "."]) == "저는 학교에 갔다."
    assert cjk.join_of(["学", "习", "Python", "3", "编程"]) == "学习 Python 3 编程" and cjk.join_of([]) == "" and cjk.join_of([" ", "a", " "]) == "a"


def test_video_list(spark, tmp_path):
    from cueforge.sources import files

    for name in ("b.v2.srt", "a.srt", "c.txt", ".srt"):
        (tmp_path / name).write_text("x")
    assert [r.video for r in files.video_list(spark, str(tmp_path)).collect() if r.video] == ["a", "b.v2"]


def test_joined_lines_are_a_step(spark):
    content = "1\n00:00:01,000 --> 00:00:02,000\none\ntwo  x\n\n2\n00:00:03,000 --> 00:00:04,000\nplain\n"
    parsed = C.parse_cues(spark.createDataFrame([("f", content)], "path string, content string"))
    cleaned = C.clean_text(parsed.drop("raw"), steps="steps")
    got = {r.pos: [(x.rule_id, x.before, x.after) for x in r.steps] for r in C.with_joined_lines(parsed, cleaned, ["path"]).collect()}
    assert got == {0: [("E2", "one\ntwo  x", "one two  x"), ("C8", "one two  x", "one two x")], 1: []}
    counts = C.rule_counts(C.with_joined_lines(parsed, cleaned, ["path"]), ["path"]).collect()
    assert sorted((r.rule_id, r.n) for r in counts) == [("C8", 1), ("E2", 1)]


def test_traced_rules_run_once(spark):
    """A filter on the steps, such as explode() brings, stays above the rules; fenced and marked texts are traced as they are shown."""
    rows = spark.createDataFrame([("x , [? a , b ?] ,  y",), ("⟦0⟧ , z",), (None,), ("plain",)], "text string")
    found = C.clean_text(rows, steps="steps").select("text", F.explode("steps").alias("s"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]
    got = sorted((r.text, r.s.rule_id, r.s.before, r.s.after) for r in found.collect())
    assert got == [
        ("x, [? a , b ?], y", "C7", "x , [? a , b ?] , y", "x, [? a , b ?], y"), ("x, [? a , b ?], y", "C8", "x , [? a , b ?] ,  y", "x , [? a , b ?] , y"),
        ("⟦0⟧, z", "C7", "⟦0⟧ , z", "⟦0⟧, z"),
    ]
