"""Personal data: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Everything over the texts is DataFrame and SQL functions. The driver holds only the table of vote
patterns, whose size is bounded by the number of labelers, and a bounded number of patterns of votes and traits.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import discard, materialize

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns. Possessive loops and the start conditions match what the plain patterns match
#: (a start inside a run that failed from its beginning fails as well), in linear time.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Names that come before a secret, as far as ``=`` or ``:``.
LABEL = (
    r"(?=[acekmpstACEKMPSTпП密])(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|auth|encryption|signing)[_-]?key"
    r"|passwort|kennwort|contraseña|mot\x20de\x20passe|senha|[пП]ароль|ПАРОЛЬ|密码|密碼)"
    r"(?:[_-][A-Za-z0-9]{1,20}){0,4}+(?![A-Za-z0-9])[\x22\x27]?\x20{0,2}[:=：]\x20{0,2}[\x22\x27]?"
)
#: Forms of keys that their issuers begin alike, signed tokens and bearer headers.
ISSUED = (
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|AIza[A-Za-z0-9_-]{35}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?"
    r"|(?:[Bb]earer|BEARER)\x20{1,2}[A-Za-z0-9._~+/=-]{16,}+)"
)
#: Literals of which one is in every text with a labelled or issued secret or a key block.
SECRET_MARKS = "= : ： AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox AIza k_live_ k_test_ sk- eyJ PRIVATE earer BEARER"
_RUN = r"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_=-].)(?<=(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z]).)[A-Za-z0-9+/_-]{31,}+={0,2}"
_PEM = r"(?:[A-Z0-9]{1,12}\x20){0,3}PRIVATE\x20KEY-----"
#: Further candidates: national and looser forms, and secrets by label, by issuer's prefix, as key blocks and as long runs of mixed characters.
LOOSE = {
    "ip": rf"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z_:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|::(?:{_GROUP}:){{0,6}}{_GROUP}|(?:{_GROUP}:){{1,7}}:)(?![0-9A-Za-z_:])",
    "card": r"[0-9](?<![0-9][0-9])[0-9]{3}(?:(?:[\x20-]?[0-9]{4}){3}|[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?=[+(0-9])(?:\+?[0-9](?<![0-9][0-9])[0-9]{0,2}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}"
    r"|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!-))(?![0-9])",
    "secret": rf"{LABEL}(?:(?i:bearer|basic)\x20{{1,2}})?+[^\s\x22\x27,;|]{{6,}}+|(?<![A-Za-z0-9]){ISSUED}"
    rf"|-----BEGIN\x20{_PEM}(?:\s*+[A-Za-z0-9+/=]{{16,}}+)*+(?:\s*+[A-Za-z0-9+/=]{{1,15}}+(?=\s*+-----END))?+(?:\s*+-----END\x20{_PEM})?+"
    rf"|{_RUN}",
    "iban": r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"[0-9](?<![0-9A-Za-z.-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a pattern to be tried at all.
GUARDS = {"email": ["@"], "phone": ["+"], "ip?": [":"], "ssn?": ["-"], "secret?": [*SECRET_MARKS.split(), lambda text: _has(text, _RUN)]}

#: Gazetteers and context words.
TLDS = "com org net edu gov mil int info biz io co uk de fr es it nl pt br eu ch at be se no dk fi pl cz ru ua jp cn kr in au nz ca us mx ar cl za tr gr ie il"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
CONTEXT = {
    "email": ("mail|contact|write|reach|address|kontakt|correo|courriel", "version|package"),
    "ip": ("ip|host|server|addr|login|from|client", "version|release|section|chapter|v\\."),
    "card": ("card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte", "isbn|order|invoice|serial|tracking"),
    "phone": ("phone|tel|call|fax|mobile|cell|contact|anruf|llame|appel", "isbn|order|invoice|serial"),
    "secret": ("login|user|credential|auth|config|export|key|secret|token", "forgot|reset|example|sha[0-9]|digest|checksum|integrity|commit"),
    "iban": ("iban|account|bank|konto|cuenta|compte|transfer", "isbn|order|serial|part"),
    "ssn": ("ssn|social|security|tax|insurance", "isbn|order|invoice|serial|part|ticket"),
}

_BLOCK = 256


def _has(text: str, regex: str) -> str:
    return f"{text} rlike '{regex.replace("\\", "\\\\").replace("'", "\\'")}'"


def _occurrences(text: str, regex: str, guard: list, rare: bool = False) -> str:
    """SQL: array of (start, end, value, before, after) of the leftmost non-overlapping matches.

    One pass marks the matches; the pieces between the marks give the places. Pieces are summed by
    block first, so the work is near linear in the matches. For a ``rare`` pattern a text without a match is only scanned.
    """
    quoted = regex.replace("\\", "\\\\").replace("'", "\\'")
    cut = f"split(regexp_replace(translate({text}, '\\u0001', '\\u0002'), '{quoted}', '\\u0001$0\\u0001'), '\\u0001')"
    item = "named_struct('start', a.at, 'end', a.at + length(x), 'value', x, 'before', right(p[a.k - 1], 30), 'after', left(p[a.k + 1], 1))"
    span = "struct<start: bigint, end: bigint, value: string, before: string, after: string>"
    empty = f"cast(array() as array<{span}>)"
    blocks = f"sequence(0, (size(p) - 1) div {_BLOCK})"
    own = f"slice(p, b * {_BLOCK} + 1, {_BLOCK})"
    block = f"""aggregate({own}, named_struct('at', aggregate(slice(sums, 1, b), 0L, (s, x) -> s + x), 'k', b * {_BLOCK}, 'out', {empty}),
        (a, x) -> named_struct('at', a.at + length(x), 'k', a.k + 1, 'out', if(a.k % 2 = 1, array_append(a.out, {item}), a.out)), a -> a.out)"""
    sums = f"transform({blocks}, b -> aggregate({own}, 0L, (s, x) -> s + length(x)))"
    found = f"element_at(transform(array({cut}), p -> element_at(transform(array({sums}), sums -> flatten(transform({blocks}, b -> {block}))), 1)), 1)"
    tried = f"({' or '.join(f"contains({text}, '{g}')" if isinstance(g, str) else g(text) for g in guard) or 'true'})" + (f" and {text} rlike '{quoted}'" if rare else "")
    return f"if({tried}, {found}, {empty})"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_LUHN = f"""element_at(transform(array({_DIGITS}), d -> aggregate(sequence(1, greatest(length(d), 1)), 0, (s, i) ->
    s + element_at(transform(array(coalesce(try_cast(substr(d, length(d) - i + 1, 1) as int), 0) * if(i % 2 = 0, 2, 1)), v -> v - if(v > 9, 9, 0)), 1)) % 10 = 0), 1)"""
_PARTS = "split(x.value, '[.]')"
_GROUPS = "size(filter(split(x.value, ':'), g -> g <> ''))"
#: Which matches of a base pattern count.
VALID = {
    "email": "true",
    "ip": f"forall({_PARTS}, o -> element_at(transform(array(ltrim('0', o)), z -> length(z) <= 3 and coalesce(try_cast(z as int), 0) <= 255), 1))",
    "card": f"length(x.value) >= 16 and length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _list(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


_LABELLED = "x.value rlike '^" + LABEL.replace("\\", "\\\\") + "'"
#: A secret without its label, and whether it looks drawn at random: little is left of it in words of four small letters.
_BODY = "regexp_replace(x.value, '^" + LABEL.replace("\\", "\\\\") + "', '')"
_RANDOM = f"element_at(transform(array({_BODY}), v -> v rlike '[0-9]' and length(regexp_replace(v, '[a-z]{{4,}}|[/_-]', '')) * 2 > length(v) and size(array_distinct(split(v, ''))) >= least(10, length(v) div 2)), 1)"
_ISSUED = "x.value rlike '^(" + ISSUED.replace("\\", "\\\\") + "|-----BEGIN)'"
#: The number that an IBAN's letters and digits spell, its first four last, modulo 97.
_CHECK = """element_at(transform(array(replace(x.value, ' ', '')), v -> aggregate(split(concat(substr(v, 5), left(v, 4)), ''), 0,
    (s, c) -> (s * if(c rlike '[A-Z]', 100, 10) + coalesce(cast(conv(c, 36, 10) as int), 0)) % 97)), 1)"""

#: SQL votes by labeler, then by kind: 1 for private, -1 against, 0 no opinion.
_FORM = {
    "email": "if(x.value rlike '^[.]|[.][.]|[.]@', -1, 1)",
    "ip": f"if(x.value like '%:%', if(x.value rlike '[0-9]' and {_GROUPS} >= 3, 1, -1), if(exists({_PARTS}, o -> length(o) > 1 and o like '0%') or x.value rlike '^(0|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]', -1, 1))",
    "card": f"if({_LUHN}, 1, -1)",
    "phone": f"if(length({_DIGITS}) between 10 and 15 and not (length({_DIGITS}) = 10 and {_DIGITS} rlike '^([01]|...[01])'), 1, -1)",
    "secret": f"if({_RANDOM} or x.value like '-----BEGIN%', 1, -1)",
    "iban": f"if({_CHECK} = 1, 1, -1)",
    "ssn": "if(x.value rlike '^(000|666|9)|-00-|-0000$', -1, 1)",
}
_GAZETTEER = {
    "email": f"if(lower(substring_index(x.value, '.', -1)) in ({_list(TLDS)}), 1, -1)",
    "ip": "if(x.value rlike '^(10[.]|127[.]|192[.]168[.]|::1$|[Ff][Ee]80:)', -1, 0)",
    "card": "if(left(x.value, 1) in ('3', '4', '5', '6'), 1, -1)",
    "phone": f"if(x.value like '+%', if(exists(array({_list(CALLING_CODES)}), c -> startswith(ltrim('+', x.value), c)), 1, -1), if(x.value like '(%', 1, 0))",
    "secret": f"if({_ISSUED} or lower(x.value) rlike '^(password|passwd|secret|api)', 1, 0)",
    "iban": f"if(left(x.value, 2) in ({_list(IBAN_COUNTRIES)}), 1, -1)",
    "ssn": "if(x.value in ('123-45-6789', '078-05-1120', '219-09-9999'), -1, 0)",
}
_REGEX = {k: f"if({v}, 1, {-1 if k == 'card' else 0})" for k, v in VALID.items()} | {
    "ip": f"if(x.value like '%:%', if({_GROUPS} >= 3, 1, -1), if({VALID['ip']}, 1, 0))",
    "card": f"if({VALID['card']} or (length({_DIGITS}) = 15 and {_DIGITS} rlike '^3[47]'), 1, -1)",
    "secret": f"if({_ISSUED} or ({_LABELLED} and x.value rlike '='), 1, 0)",
    "iban": f"if(length(replace(x.value, ' ', '')) between 15 and 34 and {_CHECK} = 1, 1, -1)",
    "ssn": "if(x.value rlike '^(000|666|9)|-00-|-0000$', -1, 1)",
}


def _context(kind: str) -> str:
    yes, no = (w.replace("\\", "\\\\") for w in CONTEXT[kind])
    return f"if(lower(x.before) rlike '({no})', -1, if(lower(x.before) rlike '({yes})', 1, 0))"


LABELERS = ("regex", "form", "gazetteer", "context", "edge")
#: Hash classes of the word before a span.
NEAR = 32


def _edge(kind: str) -> str:
    """A span cut out of a longer word speaks against it; a whole word, or the name before a secret's label, says nothing."""
    left = "right(x.before, 1) rlike '[A-Za-z0-9_]'" + (f" and not {_LABELLED}" if kind == "secret" else "")
    return f"if(({left}) or x.after rlike '[A-Za-z0-9_]', -1, 0)"


def _traits(kind: str) -> str:
    """What the classifier sees of a span beside the votes: length, share of digits, classes of characters, variety, and the word before it."""
    value = _BODY if kind == "secret" else "x.value"
    classes = " + ".join(f"if(v rlike '{c}', {1 << k}, 0)" for k, c in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))
    word = r"lower(regexp_extract(x.before, '(\\p{L}+)[^\\p{L}]*$', 1))"
    own = f"""array(least(length(v) div 8, 5), length(regexp_replace(v, '[^0-9]', '')) * 4 div greatest(length(v), 1), {classes},
        least(size(array_distinct(split(v, ''))) div 6, 4), element_at(transform(array({word}), w -> if(w = '', {NEAR}, pmod(crc32(cast(w as binary)), {NEAR}))), 1))"""
    return f"element_at(transform(array({value}), v -> transform({own}, t -> cast(t as int))), 1)"


def _labelled(kind: str, spans: str, base: bool) -> str:
    votes = [_REGEX[kind], _FORM[kind], _GAZETTEER[kind], _context(kind), _edge(kind)]
    return f"transform({spans}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'base', {str(base).lower()}, 'votes', array({', '.join(votes)}), 'shape', {_traits(kind)}))"


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``_spans``: base spans and further candidates, each with its votes."""
    body = f"coalesce(cast(`{text}` as string), '')"
    base = [_labelled(k, f"filter({_occurrences(body, BASE[k], GUARDS.get(k, []))}, x -> {VALID[k]})", True) for k in BASE]
    docs = docs.withColumn("_base", F.expr(f"concat({', '.join(base)})"))
    loose = [_labelled(k, _occurrences(body, LOOSE[k], GUARDS.get(f"{k}?", []), True), False) for k in LOOSE]
    docs = docs.withColumn("_loose", F.expr(f"concat({', '.join(loose)})"))
    # A secret or an account number may hold a base span whole; else a candidate may touch none.
    inside = "x.kind in ('secret', 'iban') and x.start <= y.start and y.end <= x.end"
    free = f"filter(_loose, x -> not exists(_base, y -> y.start < x.end and x.start < y.end and not ({inside})))"
    return docs.withColumn("_spans", F.expr(f"concat(_base, {free})")).drop("_base", "_loose")


@dataclass
class SpanModel:
    """Log-odds of a span: a weight for each kind, for each vote of any kind and of one kind, and for each trait."""

    bias: dict[str, float] = field(default_factory=dict)
    shared: dict[tuple[int, int], float] = field(default_factory=dict)
    votes: dict[tuple[str, int, int], float] = field(default_factory=dict)
    shapes: dict[tuple[int, int], float] = field(default_factory=dict)

    @staticmethod
    def features(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[tuple[str, object]]:
        cast = [(k, v) for k, v in enumerate(votes) if v]
        return [("bias", kind), *(("shared", x) for x in cast), *(("votes", (kind, *x)) for x in cast), *(("shapes", x) for x in enumerate(shape))]

    def sql(self, x: str) -> str:
        """The sum of the weights as SQL over a struct of kind, votes and shape."""
        parts = [f"case {x}.kind {' '.join(f"when '{k}' then {w:.9g}D" for k, w in sorted(self.bias.items()))} else 0D end"] if self.bias else []
        for n in range(len(LABELERS)):
            own = [(f"{x}.kind = '{k}' and {x}.votes[{n}] = {v}", w) for (k, i, v), w in sorted(self.votes.items()) if i == n]
            any_kind = [(f"{x}.votes[{n}] = {v}", w) for (i, v), w in sorted(self.shared.items()) if i == n]
            parts += ["case " + " ".join(f"when {c} then {w:.9g}D" for c, w in told) + " else 0D end" for told in (own, any_kind) if told]
        for n in sorted({i for i, _ in self.shapes}):
            parts.append(f"case {x}.shape[{n}] {' '.join(f'when {v} then {w:.9g}D' for (i, v), w in sorted(self.shapes.items()) if i == n)} else 0D end")
        return " + ".join(parts) or "-1D"


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def reliabilities(patterns: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """Posterior of each (kind, votes, shape): EM over labelers that are independent given the truth."""
    after = {}
    for kind, votes, shape, _ in patterns:
        after[kind, votes, shape] = _sigmoid(1.0 * sum(votes) - 0.5)
    for _ in range(rounds):
        prior: dict = {}
        seen: dict = {}
        for kind, votes, shape, n in patterns:
            p = after[kind, votes, shape]
            for truth, share in ((1, p), (0, 1 - p)):
                prior[kind, truth] = prior.get((kind, truth), 1.0) + n * share
                for k, v in enumerate(votes):
                    seen[kind, k, v, truth] = seen.get((kind, k, v, truth), 0.0) + n * share
        for kind, votes, shape, _ in patterns:
            log = {}
            for truth in (1, 0):
                total = prior[kind, truth]
                # A labeler is taken to be right more often than not: two pseudo votes for, one against.
                log[truth] = math.log(total) + sum(math.log((seen.get((kind, k, v, truth), 0.0) + (2 if (v > 0) == bool(truth) else 1)) / (total + 4)) for k, v in enumerate(votes) if v)
            after[kind, votes, shape] = _sigmoid(log[1] - log[0])
    return after


def fit(docs: DataFrame, text: str = "text", bound: int = 20_000) -> SpanModel:
    """Estimate the labelers by EM and train the span classifier on its posteriors.

    EM sees the counts of all (kind, votes), at most 7 * 3^5 rows. The classifier, a ridge logistic regression, sees
    the ``bound`` most frequent (kind, votes, traits), and every possible (kind, votes) at a tenth of the weight, so that
    kinds which the corpus lacks are judged as the labelers' votes weigh by EM's prior.
    """
    # Outer, or else the spans were found once more for a filter on their number.
    x = candidates(docs, text).select(F.explode_outer("_spans").alias("x")).where("x is not null")
    table = materialize(x.groupBy("x.kind", "x.votes", "x.shape").count(), "span-patterns")
    voted = {(r["kind"], tuple(r["votes"])): r["n"] for r in table.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()}
    seen = [(r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in table.orderBy(F.desc("count"), "kind", "votes", "shape").limit(bound).collect()]
    discard(table)
    possible = sorted(set(itertools.product(KINDS, itertools.product((-1, 0, 1), repeat=len(LABELERS)))) | set(voted))
    target = reliabilities([(kind, votes, (), voted.get((kind, votes), 0)) for kind, votes in possible])
    rows = [(kind, votes, shape, math.sqrt(n)) for kind, votes, shape, n in seen]
    share = 0.1 * max(sum(w for *_, w in rows), 10.0) / len(possible)
    rows += [(kind, votes, (), share) for kind, votes in possible]
    names = sorted({f for kind, votes, shape, _ in rows for f in SpanModel.features(kind, votes, shape)}, key=str)
    place = {f: k for k, f in enumerate(names)}
    told = np.zeros((len(rows), len(names)))
    for k, (kind, votes, shape, _) in enumerate(rows):
        told[k, [place[f] for f in SpanModel.features(kind, votes, shape)]] = 1
    weight, wanted = np.array([w for *_, w in rows]), np.array([target[kind, votes, ()] for kind, votes, *_ in rows])
    found, ridge = np.zeros(len(names)), 0.5
    for _ in range(20):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(told @ found, -30, 30)))
        slope = told.T @ (weight * (wanted - p)) - ridge * found
        step = np.linalg.solve((told.T * (weight * np.maximum(p * (1 - p), 1e-3))) @ told + ridge * np.eye(len(names)), slope)
        found += step
        if np.abs(step).max() < 1e-6:
            break
    model = SpanModel()
    for (group, key), w in zip(names, found, strict=True):
        getattr(model, group)[key] = float(w)
    return model


def detect(docs: DataFrame, text: str = "text", model: SpanModel | None = None, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, base, score), by kind as listed, then start.

    Places count code points, ends are exclusive. Base spans always stay; a further candidate
    stays if the classifier gives it over one half and it overlaps no span before it. Null and
    empty texts have no spans. Rows are independent: repeated rows give repeated results, an empty table none. All
    columns stay, but one named ``out`` is replaced.
    """
    model = fit(docs.select(text), text) if model is None else model
    scored = f"transform(_spans, x -> named_struct('rank', array_position(array({_list(' '.join(KINDS))}), x.kind), 'start', x.start, 'end', x.end, 'kind', x.kind, 'base', x.base, 'score', 1 / (1 + exp(-({model.sql('x')})))))"
    kept = f"array_sort(filter({scored}, x -> x.base or x.score > 0.5))"
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = candidates(docs.select(whole, F.col(f"`{text}`").cast("string").alias("text"))).withColumn("_spans", F.expr(kept))
    clear = "not exists(_spans, y -> not y.base and y.rank < x.rank and y.start < x.end and x.start < y.end)"
    found = found.withColumn("_spans", F.expr(f"filter(_spans, x -> x.base or {clear})"))
    told = F.expr("transform(_spans, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'base', x.base, 'score', x.score))").alias(out)
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != out.lower()], told)


def span_list(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redact(docs: DataFrame, text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = detect(docs.select(whole, F.col(f"`{text}`").cast("string").alias("text")), "text", model)
    # By start, the longest first, so that a merged span has the kind of its first and longest.
    ordered = "transform(array_sort(transform(spans, x -> named_struct('start', x.start, 'back', -x.end, 'kind', x.kind))), x -> named_struct('start', x.start, 'end', -x.back, 'kind', x.kind))"
    merged = f"""aggregate({ordered}, cast(array() as array<struct<start: bigint, end: bigint, kind: string>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end > x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'kind', element_at(a, -1).kind))),
           array_append(a, x)))"""
    found = found.withColumn("_cut", F.expr(f"if(size(spans) = 0, cast(array() as array<struct<start: bigint, end: bigint, kind: string>>), {merged})"))
    gap = "substr(text, cast(if(i = 0, 0, _cut[i - 1].end) as int) + 1, cast(x.start - if(i = 0, 0, _cut[i - 1].end) as int))"
    told = f"concat(array_join(transform(_cut, (x, i) -> concat({gap}, '[', upper(x.kind), ']')), ''), substr(text, cast(element_at(_cut, -1).end as int) + 1))"
    new = F.expr(f"if(size(_cut) = 0, text, {told})").alias(text)
    return found.select(*[new if c == text else F.col(f"row.`{c}`") for c in docs.columns])
