"""Quality checks over (source, target) rows as arrays of issues, and scenes that run them in order.

A check gives an array of struct(rule, severity, message); an empty array means nothing found. run_scene() concatenates
the checks' issues in order and stops after the first check that raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .text import SANITIZERS, rtrim, trim, white_split

ISSUES = "array<struct<rule:string,severity:string,message:string>>"


def issue(rule: str, severity: Column | str, message: Column | str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    message = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), message.alias("message"))).cast(ISSUES)


def nothing() -> Column:
    return F.array().cast(ISSUES)


def found(test: Column, rule: str, severity, message) -> Column:
    return F.when(test, issue(rule, severity, message)).otherwise(nothing())


def _contains_any(c: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(c, F.lit(w.lower()))
    return test


def non_empty(src, tgt, row, severity, **_):
    return found((trim(src) != "") & (trim(tgt) == ""), "non_empty", severity, "translation is empty")


def length_bounds(src, tgt, row, severity, abs_max=200, short_target_max=3, short_target_inverse_ratio=4.0, **_):
    s, t = trim(src), trim(tgt)
    ns, nt = F.length(s), F.length(t)
    both = (s != "") & (t != "")
    return (
        F.when(both & (nt > abs_max), issue("length_abs_max", severity, "translation is longer than the cap"))
        .when(both & (nt <= short_target_max) & (ns > short_target_inverse_ratio * nt), issue("length_short_target", severity, "translation is too short for its source"))
        .otherwise(nothing())
    )


def estimated_words(c: Column) -> Column:
    """Words; characters of CJK scripts where they are more than 30 % of the text."""
    s = trim(c)
    cjk = F.length(F.regexp_replace(s, f"[^{T.CHECK_CJK}]", ""))
    return F.when(cjk > F.length(s) * 0.3, cjk).otherwise(F.size(white_split(s)))


def length_ratio(src, tgt, row, severity, thresholds=T.RATIOS["same"], **_):
    s, t = trim(src), trim(tgt)
    words = estimated_words(src)
    a, b, c, d = thresholds
    limit = F.when(words < 3, F.lit(a)).when(words < 8, F.lit(b)).when(words < 20, F.lit(c)).otherwise(F.lit(d))
    return found((s != "") & (t != "") & (F.length(t) / F.length(s) > limit), "length_ratio", severity, "translation is too long for its source")


def format_artifacts(src, tgt, row, severity, hallucination_starts=(), allow_newlines=False, **_):
    s, t = trim(src), trim(tgt)
    low = F.lower(t)
    blocks = (F.length(t) - F.length(F.replace(t, F.lit("$$"), F.lit("")))) / 2
    out = [
        found(F.contains(t, F.lit("\n")) & (blocks < 2), "format_newline", severity, "unexpected newline in translation") if not allow_newlines else nothing(),
        found(F.contains(t, F.lit("**")), "format_markdown", severity, "markdown in translation"),
    ]
    starts = F.lit(False)
    for pattern, but in hallucination_starts:
        starts = starts | low.rlike(f"(?U)^(?:{pattern})" + (f"(?!{but})" if but else ""))
    out.append(found(starts, "format_hallucination", severity, "translation starts as a reply"))
    out.append(found(t.rlike(r"^[（【\[(]") & ~s.rlike(r"^[\[(]"), "format_bracket", severity, "translation starts with a bracket but its source does not"))
    return F.concat(*out)


def question_mark(src, tgt, row, severity, source_marks=("?", "？"), expected_marks=("?",), whitelist=("right?", "ok?", "okay?", "okey?", "why?"), **_):
    s = rtrim(src)
    asks = F.lit(False)
    for m in source_marks:
        asks = asks | F.endswith(s, F.lit(m))
    casual = F.lit(False)
    for w in whitelist:
        casual = casual | F.endswith(F.lower(s), F.lit(w))
    answered = F.lit(False)
    for m in expected_marks:
        answered = answered | F.contains(tgt, F.lit(m))
    return found(asks & ~answered, "question_mark", F.when(casual, "info").otherwise(F.lit(severity)), "source asks but translation does not")


def keywords(src, tgt, row, severity, forbidden_terms=(), keyword_pairs=(), **_):
    s, t = F.lower(src), F.lower(tgt)
    odd = F.lit(False)
    for source_words, target_words in keyword_pairs:
        odd = odd | (_contains_any(t, target_words) & ~_contains_any(s, source_words))
    return F.concat(
        found(_contains_any(t, list(forbidden_terms)), "keyword_forbidden", severity, "forbidden term"),
        found(odd, "keyword_inconsistency", severity, "target has a concept that its source lacks"),
    )


def output_tokens(src, tgt, row, severity, max_output=800, short_input_threshold=50, short_input_max_output=80, output_input_ratio_max=10.0, **_):
    given, made = row("prompt_tokens"), row("completion_tokens")
    return (
        F.when(made > max_output, issue("output_tokens_max", severity, "too many tokens"))
        .when((given > 0) & (given < short_input_threshold) & (made > short_input_max_output), issue("output_tokens_short_input", severity, "short input with a long output"))
        .when((given > 0) & (made / given > output_input_ratio_max), issue("output_tokens_ratio", severity, "output is too long for its input"))
        .otherwise(nothing())
    )


def cjk_content(src, tgt, row, severity, target_lang="", short_passthrough_max=10, **_):
    if target_lang not in T.CJK:
        return nothing()
    t = trim(tgt)
    passed = (trim(src) == t) & (F.length(t) <= short_passthrough_max)
    return found((t != "") & ~t.rlike(f"[{T.CHECK_CJK}]") & ~passed, "cjk_content", severity, "translation has no CJK characters")


def trailing_annotation(src, tgt, row, severity, min_non_ascii=12, **_):
    note = F.regexp_extract(tgt, r"（([^（）]*?)）[,.?;!，。？；！]*$", 1)
    return found(F.length(F.regexp_replace(note, r"[\x00-\x7F]", "")) > min_non_ascii, "trailing_annotation", severity, "long note in brackets at the end")


CHECKS = {f.__name__: f for f in (non_empty, length_bounds, length_ratio, format_artifacts, question_mark, keywords, output_tokens, cjk_content, trailing_annotation)}


def register(name: str, check) -> None:
    """Add a check: f(source, target, row, severity, **parameters) -> array of issues."""
    CHECKS[name] = check


#: Scenes: sanitize steps, then (check, severity); `extends` scenes come first, later rules of the same name win.
SCENES = T.SCENES


def resolve_scene(name: str, scenes: dict | None = None, _open: tuple = ()) -> dict:
    """(sanitize steps, rules with severity and parameters) of a scene with its parents."""
    scenes = SCENES | (scenes or {})
    if name in _open:
        raise ValueError("scenes extend each other: " + " -> ".join([*_open, name]))
    if name not in scenes:
        raise KeyError(f"no scene {name!r}")
    own = scenes[name]
    sanitize, rules = {}, {}
    for parent in own.get("extends", ()):
        above = resolve_scene(parent, scenes, (*_open, name))
        for step in above["sanitize"]:
            sanitize.pop(step, None)
            sanitize[step] = True
        for rule in above["rules"]:
            rules.pop(rule[0], None)
            rules[rule[0]] = rule
    for step in own.get("sanitize", ()):
        sanitize.pop(step, None)
        sanitize[step] = True
    for rule in own.get("rules", ()):
        rules.pop(rule[0], None)
        rules[rule[0]] = (rule[0], rule[1], dict(rule[2]) if len(rule) > 2 else {})
    for gone in own.get("disable", ()):
        rules.pop(gone, None)
        sanitize.pop(gone, None)
    for rule, change in own.get("overrides", {}).items():
        if rule in rules:
            _, severity, parameters = rules[rule]
            rules[rule] = (rule, change.get("severity", severity), parameters | change.get("params", {}))
    return {"sanitize": list(sanitize), "rules": list(rules.values())}


def pair_scene(source_lang: str, target_lang: str, profile: str = "strict") -> dict:
    """The scene of a language pair."""
    empty = {"script": "latin", "forbidden": [], "starts": [], "marks": ["?"], "concepts": {}}
    s, t = T.PROFILES.get(source_lang, empty), T.PROFILES.get(target_lang, empty)
    direction = "same" if (s["script"] == "cjk") == (t["script"] == "cjk") else "cjk_to_latin" if s["script"] == "cjk" else "latin_to_cjk"
    scene = {
        "extends": [f"translate.{profile}"],
        "overrides": {
            "length_ratio": {"params": {"thresholds": T.RATIOS[direction]}},
            "format_artifacts": {"params": {"hallucination_starts": t["starts"]}},
            "question_mark": {"params": {"source_marks": s["marks"], "expected_marks": t["marks"]}},
            "keywords": {"params": {"forbidden_terms": t["forbidden"], "keyword_pairs": [(w, t["concepts"][k]) for k, w in s["concepts"].items() if k in t["concepts"]]}},
            "cjk_content": {"params": {"target_lang": target_lang}},
        },
    }
    return resolve_scene("pair", {"pair": scene})


def sanitized(scene: dict, source: Column, target: Column) -> Column:
    for step in scene["sanitize"]:
        target = SANITIZERS[step](target, source)
    return target


def run_scene(scene: dict, source: Column, target: Column, row=F.col) -> Column:
    """The issues, in order, up to and with the first check that raises an error. row(name) gives other columns."""
    checks = [CHECKS[name](source, target, row, severity, **parameters) for name, severity, parameters in scene["rules"]]
    if not checks:
        return nothing()
    bad = lambda issues: F.exists(issues, lambda x: x["severity"] == "error")
    return F.aggregate(F.array(*checks), nothing(), lambda acc, x: F.when(bad(acc), acc).otherwise(F.concat(acc, x)))


def passed(issues: Column) -> Column:
    return ~F.exists(issues, lambda x: x["severity"] == "error")


def score(issues: Column) -> Column:
    """(errors, warnings), which compare in this order."""
    n = lambda s: F.size(F.filter(issues, lambda x: x["severity"] == s))
    return F.struct(n("error").alias("errors"), n("warning").alias("warnings"))


def keep_better(issues: Column, prior_issues: Column, target: Column, prior: Column) -> Column:
    """The prior translation where the new one scores worse."""
    return F.when(prior.isNotNull() & (score(issues) > score(prior_issues)), prior).otherwise(target)


__all__ = ["CHECKS", "SCENES", "pair_scene", "passed", "register", "resolve_scene", "run_scene", "sanitized", "score"]
