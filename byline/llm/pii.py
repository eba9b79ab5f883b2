"""Personal data by candidate gradient boosting, in columns only.

Strict patterns with checks find the plain cases. Generators of high recall propose further spans, which may overlap; each
gets features of its format and of the text around it, boosted trees score it, and a threshold per kind, calibrated on
candidates the trees have not seen, decides. No labels are needed: examples for the trees are the plain cases as they stand
and rewritten the way people disguise them; examples against are candidates that touch no plain case, and plain cases with
a digit changed, so that their checks fail.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byline.functions.text import bind
from byline.llm.staging import staged, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
# Starts inside a run are left out where they cannot be the leftmost match, and loops keep what they took where giving
# back cannot help: the matches are those of the plain patterns, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\s?\.\s?|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
GENERATORS = {
    "email": [rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,63}}){{1,8}}"],
    "ip": [rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\s?[,_:-]\s?)[0-9]{{1,3}}){{3}}(?![0-9])",
           r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}(?![0-9a-f:])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20./_·-]{0,3}[0-9]){11,18}(?![0-9])"],
    "phone": [r"(?<![0-9+(])(?:\+|00\s?)?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])"],
}
CUES = {"email": r"(?i)mail|contact|correo|courriel|adress|write|schreib", "ip": r"(?i)\bip\b|host|server|addr|adress|serveur|servidor",
        "card": r"(?i)card|karte|tarjeta|carte|visa|credit|kredit|cr[eé]dit", "phone": r"(?i)phone|tel[eéè.:]|tel\b|call|mobil|m[oó]vil|fax|ruf"}
AGAINST = r"(?i)(?:version|isbn|issn|page|seite|p[aá]gina|figure|section|§|year|date|[=\"'#$€£])\s*$"
BEFORE, AFTER = 24, 12
FEATURES = ["kind", "digits", "length", "groups", "longest", "shortest", "letters", "plus", "paren", "at", "word_at", "bracket", "word_dot", "dots",
            "octets", "luhn", "blanks", "spaced", "same_separator", "tail", "hex", "left_kind", "right_kind", "cue", "against"]
REWRITES = {
    "email": [[("@", " (at) "), (r"\.", " (dot) ")], [("@", " [at] ")], [("@", " at "), (r"\.", " dot ")], [("@", " @ "), (r"\.", " . ")], [("@", "[at]"), (r"\.", "[dot]")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", " . ")], [(r"\.", "(.)")], [(r"\.", " dot ")]],
    "card": [[("[ -]", ""), ("([0-9]{4})(?=[0-9])", f"$1{s}")] for s in (".", "/", "_", "  ", " - ")],
    "phone": [[(r"^\+", "00 ")], [(r"^\+", "00")], [("[ ()-]+", "."), (r"^\.?\+", "+")], [("[ ()-]+", "/")], [(r"^\+", "")]],
}
SPOILT = {"ip": [("[0-9]+$", "617")], "card": [("1$", "2"), ("[03-9]$", "1")]}


def _starts(lengths: Column) -> Column:
    """Running totals before each element, in blocks so that long arrays are not copied for every element."""
    block = 256
    last = F.greatest(F.lit(0), ((F.size(lengths) - 1) / block).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    run = lambda a: F.aggregate(a, F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("at")),
                                lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["at"], F.array(s["n"])).alias("at")))
    bases = lambda runs: run(F.transform(runs, lambda r: r["n"]))["at"]
    return bind(F.transform(blocks, run), lambda runs: F.flatten(F.zip_with(runs, bases(runs), lambda r, base: F.transform(r["at"], lambda x: x + base))))


def _found(text: Column, pattern: str, hint: str | None) -> Column:
    """Matches of a pattern: start (code points), text, and the text around each up to the matches beside it."""
    may = text.contains(hint) if hint else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:bigint,text:string,left:string,right:string>>")
    length = lambda c: F.char_length(F.coalesce(c, F.lit(""))).cast("long")

    def placed(matches: Column) -> Column:
        def beside(pieces: Column) -> Column:
            lengths = F.zip_with(pieces, matches, lambda p, m: length(p) + length(m))
            return bind(bind(lengths, _starts), lambda at: F.transform(matches, lambda m, i: F.struct(
                (F.get(at, i) + length(F.get(pieces, i))).alias("start"), m.alias("text"),
                F.right(F.get(pieces, i), F.lit(BEFORE)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("right"))))
        return F.when(F.size(matches) == 0, none).otherwise(bind(F.split(text, pattern, -1), beside))

    # bound values are computed once; lambdas compute what else they mention again for each element
    return F.when(~may, none).otherwise(bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed))


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(text, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def with_plain_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base``: the spans (start, kind number, end, text, left, right) of the strict patterns, by start and kind."""
    text = text_or_empty(F.col(text_col))
    out = docs.withColumns({f"_{kind}": _found(text, PATTERNS[kind], HINTS[kind]) for kind in KINDS})

    def checked(i: int, kind: str) -> Column:
        return F.transform(F.filter(f"_{kind}", lambda m: _valid(kind, m["text"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(i).alias("kind"), (m["start"] + F.char_length(m["text"])).alias("end"), m["text"].alias("text"), m["left"].alias("left"), m["right"].alias("right")))

    spans = [checked(i, kind) for i, kind in enumerate(KINDS)]
    return out.withColumn("base", F.array_sort(F.concat(*spans))).drop(*[f"_{kind}" for kind in KINDS])


def features(kind: Column, text: Column, left: Column, right: Column) -> Column:
    """Numbers about a candidate's format and context, in the order of ``FEATURES``."""
    digits = F.regexp_replace(text, "[^0-9]+", "")
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.char_length(g))
    separators = F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"[()+]", ""), "[0-9A-Za-z]+"), lambda s: s != ""))
    side = lambda c: (F.when(c == "", 0).when(c.rlike("^[A-Za-zÀ-ÿ]"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^[\s|]"), 3).when(c.rlike("^[.,;:!?)(*]"), 4).otherwise(5))
    cue = F.coalesce(*[F.when(kind == i, left.rlike(CUES[k])) for i, k in enumerate(KINDS)], F.lit(False))
    word = lambda p: F.regexp_count(text, F.lit(p))
    values = [kind, F.char_length(digits), F.char_length(text), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)),
              word("[A-Za-z]"), text.startswith("+"), text.contains("("), text.rlike("[@＠]"), text.rlike(r"(?i)\sat\s"), text.rlike(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]"),
              text.rlike(r"(?i)\sdot\s"), word(r"\."), ~F.exists(groups, lambda g: (F.char_length(g) > 3) | (F.coalesce(F.try_to_number(g, F.lit("999")), F.lit(999)) > 255)),
              F.coalesce(F.call_function("luhn_check", digits), F.lit(False)), word(r"\s"), text.rlike(r"\s[@.]\s"), F.size(separators), F.char_length(F.regexp_extract(text, "[A-Za-z]*$", 0)),
              text.rlike("(?i)[a-f].*:|:.*[a-f]"), side(F.right(left, F.lit(1))), side(right), cue, left.rlike(AGAINST)]
    return F.array(*[v.cast("double") for v in values])


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``candidates``: start, kind number, end and ``x``, the features of every proposed span. They may overlap."""
    text = text_or_empty(F.col(text_col))
    names, out = [], docs
    for kind, patterns in GENERATORS.items():
        for j, pattern in enumerate(patterns):
            names.append((f"_c{kind}{j}", kind))
            hint = ":" if j else None
            found = _found(text, pattern, hint)
            if kind == "email":
                found = F.when(text.rlike(rf"(?i){_AT}"), found).otherwise(F.array())
            out = out.withColumn(names[-1][0], found)

    def described(name: str, kind: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["text"])).alias("end"),
                                                    features(F.lit(kind), m["text"], m["left"], m["right"]).alias("x")))

    return out.withColumn("candidates", F.concat(*[described(name, KINDS.index(kind)) for name, kind in names])).drop(*[n for n, _ in names])


class Model(NamedTuple):
    """``trees``: (weight, root) with inner nodes (feature, threshold, left, right) and leaves as numbers; ``thresholds`` by kind."""
    trees: list
    thresholds: dict[str, float]


def _parsed(lines: list[str]) -> tuple | float:
    """A tree from its printed form: ``If (feature i <= t)`` with its branch, then ``Else`` with the other."""
    line = lines.pop(0)
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    at = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line)
    left = _parsed(lines)
    lines.pop(0)
    return int(at[1]), float(at[2]), left, _parsed(lines)


def _column(tree: tuple | float, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(F.get(x, F.lit(feature)) <= threshold, _column(left, x)).otherwise(_column(right, x))


def score(model: Model, x: Column) -> Column:
    """Probability that a candidate with features ``x`` is personal data."""
    margin = F.lit(0.0)
    for weight, tree in model.trees:
        margin = margin + F.lit(weight) * _column(tree, x)
    return 1 / (1 + F.exp(-2 * margin))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < end) & (b["end"] > start))


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Weakly labelled candidates: ``x``, ``label``, ``weight`` (how often), ``natural`` (stands so in a text) and ``fold``."""
    rows = staged(with_candidates(with_plain_spans(docs.select(F.col(text_col).alias("text")))).select("base", "candidates"))
    natural = rows.select("base", F.inline("candidates"))
    against = natural.where(~_overlaps(F.col("base"), F.col("start"), F.col("end"))).select("x", F.lit(0.0).alias("label"), F.lit(True).alias("natural"))
    plain = rows.select(F.inline("base")).select("kind", "text", "left", "right")
    made = [(F.lit(True), F.col("text"), 1.0, True)]
    for label, book in ((1.0, REWRITES), (0.0, {k: [[s] for s in v] for k, v in SPOILT.items()})):
        for kind, ways in book.items():
            for way in ways:
                text = F.col("text")
                for pattern, by in way:
                    text = F.regexp_replace(text, pattern, by)
                made.append((F.col("kind") == KINDS.index(kind), text, label, False))
    variants = F.array(*[F.struct(use.alias("use"), text.alias("made"), F.lit(label).alias("label"), F.lit(own).alias("natural")) for use, text, label, own in made])
    shown = plain.select("kind", "text", "left", "right", F.inline(variants)).where("use").where((F.col("label") == 1) | (F.col("made") != F.col("text")))
    shown = shown.select(features(F.col("kind"), F.col("made"), F.col("left"), F.col("right")).alias("x"), "label", "natural")
    return (against.unionByName(shown).groupBy("x", "label", "natural").agg(F.count(F.lit(1)).cast("double").alias("weight"))
            .withColumn("fold", F.pmod(F.xxhash64("x", "label"), F.lit(4))))


def train(docs: DataFrame, text_col: str = "text", train_docs: int | None = None, precision: float = 0.98, trees: int = 20, depth: int = 4) -> Model | None:
    """Trees and thresholds from all texts, or from about ``train_docs`` drawn by hash; None if they hold no plain case.

    Equal feature vectors are counted, three quarters of them train and the others set, for each kind, the least threshold at which
    that share of the weight above is of true cases. A kind without true cases there gets no threshold, so it adds nothing.
    """
    rows = docs.count() if train_docs is not None else 0
    if train_docs is not None and rows > train_docs:
        docs = docs.where(F.pmod(F.xxhash64(text_or_empty(F.col(text_col))), F.lit(1 << 20)) < int((1 << 20) * train_docs / rows))
    known = staged(examples(docs, text_col))
    sums = known.groupBy((F.col("fold") == 0).alias("held")).agg(F.sum("label").alias("true"), F.sum(1 - F.col("label")).alias("false")).collect()
    if not any(not s["held"] and s["true"] and s["false"] for s in sums):
        return None
    # each side weighs alike, whatever its number of rows
    side = known.where("fold > 0").groupBy("label").agg(F.sum("weight").alias("all"))
    fit = known.where("fold > 0").join(F.broadcast(side), "label").select("label", (F.col("weight") / F.col("all") * 1000).alias("weight"), array_to_vector("x").alias("features"))
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, weightCol="weight", seed=7, stepSize=0.2).fit(fit)
    kept = []
    for weight, tree in zip(fitted.treeWeights, fitted.trees, strict=True):
        kept.append((float(weight), _parsed([line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()])))
    model = Model(kept, {})
    judged = (known.where("fold = 0").select(F.get("x", F.lit(0)).cast("int").alias("kind"), "label", "weight", F.floor(score(model, F.col("x")) * 1000).cast("int").alias("at"))
              .groupBy("kind", "at").agg(F.sum(F.col("weight") * F.col("label")).alias("true"), F.sum("weight").alias("all")).collect())
    thresholds = {}
    for i, kind in enumerate(KINDS):
        true = whole = 0.0
        for r in sorted((r for r in judged if r["kind"] == i), key=lambda r: -r["at"]):
            true, whole = true + r["true"], whole + r["all"]
            if true and true >= precision * whole and r["at"] >= 500:
                thresholds[kind] = r["at"] / 1000
    return Model(kept, thresholds)


def _chosen(base: Column, extra: Column) -> Column:
    """``extra`` spans that touch no base span; of those that overlap the best scored (ties: the first, the longer) stays."""
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(True).alias("plain"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(2.0).alias("score"))),
                                 F.transform(extra, lambda c: F.struct(c["start"].alias("start"), F.lit(False).alias("plain"), c["end"].alias("end"), c["kind"].alias("kind"), c["score"].alias("score")))))
    kind = "struct<start:bigint,plain:boolean,end:bigint,kind:int,score:double>"
    state = lambda done, last, wall: F.struct(done.alias("done"), last.alias("last"), wall.alias("wall"))

    def step(s, c):
        last, wall = s["last"], s["wall"]
        meets = last.isNotNull() & (c["start"] < last["end"])
        better = (c["score"] > last["score"]) | ((c["score"] == last["score"]) & (c["start"] == last["start"]) & (c["end"] > last["end"]))
        closed = F.when(last.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(last)))
        on_plain = state(F.when(meets, s["done"]).otherwise(closed), F.lit(None).cast(kind), F.greatest(wall, c["end"]))
        on_extra = F.when(c["start"] < wall, s).when(meets, state(s["done"], F.when(better, c).otherwise(last), wall)).otherwise(state(closed, c, wall))
        return F.when(c["plain"], on_plain).otherwise(on_extra)

    end = F.aggregate(both, state(F.array().cast(f"array<{kind}>"), F.lit(None).cast(kind), F.lit(0).cast("long")), step)
    return F.filter(F.concat(end["done"], F.array(end["last"])), lambda c: c.isNotNull())


def find_personal_data(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end) in order, starts and ends in code points.

    ``base`` are the plain cases, ``spans`` those and what the model adds. Null and empty texts have none; columns named so are replaced. All work is done in the row.
    """
    out = with_candidates(with_plain_spans(docs.drop("base", "spans"), text_col), text_col)
    limit = lambda k: F.coalesce(*[F.when(k == i, F.lit(model.thresholds[kind])) for i, kind in enumerate(KINDS) if kind in model.thresholds], F.lit(2.0))
    if model is None or not model.thresholds:
        extra = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")
    else:
        # what a plain pattern finds or rejects is not asked again
        scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score(model, c["x"]).alias("score")))
        extra = F.filter(scored, lambda c: c["score"] >= limit(c["kind"]))
    name = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(name, s["kind"]).alias("kind"), s["end"].alias("end")))
    out = out.withColumn("_extra", extra)
    out = out.withColumn("_chosen", F.when(F.size("_extra") == 0, F.array()).otherwise(_chosen(F.col("base"), F.col("_extra"))))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = out.withColumn("spans", shown(F.array_sort(F.concat(bare("base"), bare("_chosen")))))
    return out.withColumn("base", shown(F.col("base"))).drop("candidates", "_extra", "_chosen")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of ``find_personal_data`` with each span (overlapping ones together) replaced by its kind in brackets."""
    text = text_or_empty(F.col(text_col))
    state = lambda at, parts: F.struct(at.alias("at"), parts.alias("parts"))

    def step(s, x):
        part = F.concat(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < s["at"], state(F.greatest(s["at"], x["end"]), s["parts"])).otherwise(state(x["end"], F.concat(s["parts"], F.array(part))))

    end = F.aggregate("spans", state(F.lit(0).cast("long"), F.array().cast("array<string>")), step)
    rest = F.substring(text, (end["at"] + 1).cast("int"), F.char_length(text))
    return found.withColumn(text_col, F.concat(F.array_join(end["parts"], ""), rest))
