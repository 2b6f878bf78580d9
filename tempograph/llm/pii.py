"""Personal data: labelers that vote, reliabilities by expectation-maximisation, and a span classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of

# Gazetteers, public lists and plans.
#: Top-level domains in wide use.
DOMAINS = "com org net edu gov mil int info biz name io dev app co ai me tv cc eu de fr es it nl be at ch uk ie us ca au nz jp cn kr in br mx ar cl ru ua pl cz sk hu ro bg gr tr se no dk fi is pt lu lt lv ee za".split()
#: Calling codes and the least and most digits of numbers in their plans, without the code.
CODES = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (7, 10), "45": (8, 8),
    "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 13), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "61": (9, 9), "64": (8, 10), "65": (8, 8), "81": (9, 10), "82": (8, 10), "86": (11, 11),
    "90": (10, 10), "91": (10, 10), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 7), "358": (5, 12), "380": (9, 9), "420": (9, 9),
}
#: First digits of issuers' card numbers and the lengths that they have.
CARDS = (("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("3[47]", (15,)), ("6011|64[4-9]|65", (16, 17, 18, 19)), ("35", (16, 17, 18, 19)), ("30[0-5]|3[689]", (14, 15, 16, 17, 18, 19)), ("62", (16, 17, 18, 19)))
#: Countries of IBANs and the lengths that they have.
IBANS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}
#: Prefixes of keys that services give out, and what follows.
KEYS = ("(?:AKIA|ASIA)[0-9A-Z]{16}", "gh[pousr]_[0-9A-Za-z]{36}", "sk-[0-9A-Za-z]{32,64}", "xox[abpr]-[0-9A-Za-z-]{20,80}", "AIza[0-9A-Za-z_-]{35}")
#: Given names in wide use in the four languages.
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Hans Klaus Ursula Petra Stefan Sabine Jürgen Monika Pierre Jean Marie Jacques Claire Nicolas Sophie Luc Camille Antoine Carlos María José Carmen Luis Ana Javier Lucía Miguel Isabel".split()
#: What follows a given name and is no family name.
NO_FAMILY = "Street Avenue Road Day Church Park Hospital School University January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Words that streets are called by.
STREETS = "Street Avenue Road Lane Drive Boulevard Square Court"
#: What stands for a secret in examples.
PLACEHOLDERS = "password|passwort|changeme|example|placeholder|default|undefined|secret|token|your|dummy|none|null|true|false|test"
#: What a secret is assigned to.
ASSIGNED = r"(?i:password|passwd|pwd|passwort|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?"
# End of fixed values.

#: Kinds in their order, and the cheap condition under which a text can hold one. The first four are the base kinds. Patterns
#: propose the first eight, a word of the context the ninth, gazetteers the last two. Runs are possessive and start where a
#: run or the last match ends, so that long runs take linear time; what matches is the same.
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("[0-9][.][0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("[+][0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("AKIA|ASIA|gh[pousr]_|sk-|xox|AIza", rf"(?<![A-Za-z0-9])(?:{'|'.join(KEYS)})(?![A-Za-z0-9])"),
    "ssn": ("[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": ("[0-9]-[0-9]{4}", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}-[0-9]{4}(?![0-9-])"),
    "credential": (f"{ASSIGNED}[!-~]", rf"(?<={ASSIGNED})(?<![A-Za-z0-9+/_.~!@#$%^&*-])[A-Za-z0-9+/_.~!@#$%^&*-]{{8,256}}"),
    "person": (rf"\b(?:{'|'.join(GIVEN)}) ", rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(GIVEN)})\x20(?:\p{{Lu}}\.\x20)?\p{{Lu}}[\p{{Ll}}]{{1,30}}+(?:-\p{{Lu}}\p{{Ll}}{{1,30}}+)?"),
    "address": (rf"\b(?:{STREETS.replace(' ', '|')})\b|[a-z](?:straße|strasse) [0-9]|\b(?:rue|calle) ", rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}{{1,20}}\x20){{1,3}}(?:{STREETS.replace(' ', '|')})\b|\p{{Lu}}\p{{Ll}}{{1,30}}(?:straße|strasse)\x20[0-9]{{1,4}}\b|[0-9]{{1,4}},?\x20rue\x20(?:\p{{L}}{{1,20}}\x20){{0,3}}\p{{Lu}}\p{{Ll}}{{1,20}}|calle\x20(?:\p{{L}}{{1,20}}\x20){{0,3}}\p{{Lu}}\p{{Ll}}{{1,20}},?\x20[0-9]{{1,4}}\b)"),
}
BASE = ("email", "ip", "card", "phone")
_CALL = r"phone|\btel|call|fax|mobil|telefon|t[eé]l[eé]fono?"
#: Words near a span that speak of its kind, in four languages.
CUES = {
    "email": "mail|write|contact|kontakt|contacto|courriel|correo", "ip": r"\bip\b|host|server|address|adresse|login",
    "card": "card|visa|master|karte|carte|tarjeta|pay", "phone": _CALL,
    "secret": "key|token|secret|aws|api|password", "ssn": r"ssn|social|security|\bid\b", "iban": "iban|account|konto|compte|cuenta|bank", "local_phone": _CALL,
    "credential": "[:=]\\s*[\"']?$|key|token|secret|password", "person": r"\b(?:mr|mrs|ms|dr|herr|frau|mme|m|sr|sra)\.? *$|name|dear|liebe|cher|sincerely|contact|born|geboren", "address": "address|adresse|direcci|live|wohn|habite|street|located",
}
VOTES = ("format", "gazetteer", "bounds", "cue")
#: A vote of a labeler that has nothing to say of a kind: what proposed it, or what its pattern ensures.
ABSTAINS = 2
SILENT = {"format": ("local_phone", "person", "address"), "bounds": ("secret", "ssn", "iban", "local_phone", "credential", "person", "address"), "cue": ("credential",)}
#: Features of a span by itself, each with a few values.
SHAPES = ("length", "digits", "variety", "lead")
NEAR = 40


def _of(kinds: dict[str, Column], otherwise: Column) -> Column:
    """A value by the row's kind."""
    out = otherwise
    for kind, value in kinds.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, id, kind, start, end, span, before, after): all matches of all kinds, and a row without kind for each text
    that has none. Offsets count code points; start is included, end isn't. Texts stay where they are: what is shuffled is
    the matches with NEAR characters on either side."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    for kind, (hint, pattern) in KINDS.items():
        may = F.col("text").rlike(hint)
        rows = rows.withColumn(f"m_{kind}", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))

    def found(kind):
        gap = lambda k: F.get(f"p_{kind}", k)
        each = lambda t, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(gap(k)).alias("gap"), F.right(gap(k), F.lit(NEAR)).alias("before"), F.left(gap(k + 1), F.lit(NEAR)).alias("after"), t.alias("span"))
        return F.when(F.size(f"m_{kind}") > 0, F.transform(f"m_{kind}", each))

    spans = F.flatten(F.array_compact(F.array(*(found(k) for k in KINDS))))
    out = rows.select("row_id", "id", F.explode_outer(spans).alias("s")).select("row_id", "id", "s.*")
    along = Window.partitionBy("row_id", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("span")).over(along)
    return out.withColumn("end", end).select("row_id", "id", "kind", (F.col("end") - F.length("span")).alias("start"), "end", "span", "before", "after")


def _remainder(text: Column) -> Column:
    """The remainder by 97 of an IBAN turned round, letters as 10 to 35."""
    turned = F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + digit(c)).otherwise(r * 100 + digit(c)) % 97
    return F.aggregate(F.split(turned, "(?!$)"), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))


def labelled(spans: DataFrame) -> DataFrame:
    """spans with the votes (0 or 1, or 2 where one abstains) of four labelers and their shapes. format checks the span itself (checksums, lengths,
    what its parts may be), gazetteer looks its parts up in lists and numbering plans, bounds asks that no letter or digit
    touches it, cue looks for words of its kind around it. Base spans are those that pass format. Shapes are how long a span
    is, its share of digits, its share of different signs, and what stands before it."""
    span = F.col("span")
    digits, plain = F.regexp_replace("span", "[^0-9]", ""), F.regexp_replace("span", " ", "")
    part = lambda p: F.ltrim(p, F.lit("0"))
    parts = F.forall(F.split("span", r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)).between(1, 3), part(p).cast("int")), F.lit(0)) <= 255))
    signs = F.size(F.array_distinct(F.split(span, "(?!$)")))
    fits = _of({
        "ip": parts, "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", digits), "phone": F.length(digits).between(9, 15),
        "secret": span.rlike("[0-9]") & span.rlike("[A-Za-z]"), "ssn": ~span.rlike("^(000|666|9)|-00-|-0000$"), "iban": F.length(plain).between(15, 34) & (_remainder(plain) == 1),
        "credential": (signs >= 8) | (span.rlike("[0-9]") & span.rlike("[A-Za-z]") & (signs >= 6)),
    }, F.lit(True))
    plan = F.lit(False)
    for code, (least, most) in CODES.items():
        plan = plan | (digits.startswith(code) & (F.length(digits) - len(code)).between(least, most))
    issued = F.lit(False)
    for first, lengths in CARDS:
        issued = issued | (digits.rlike(f"^(?:{first})") & F.length(digits).isin(*lengths))
    country = F.substring(span, 1, 2)
    known = _of({
        "email": F.lower(F.regexp_extract("span", r"\.([A-Za-z0-9-]+)$", 1)).isin(DOMAINS), "ip": ~span.rlike(r"^0*(0|10|127|22[4-9]|2[3-9][0-9])\.|^0*192\.0*168\.|^0*169\.0*254\.|^0*172\.0*(1[6-9]|2[0-9]|3[01])\."),
        "card": issued, "phone": plan, "secret": signs >= 10, "ssn": ~span.rlike("^(123-45-6789|078-05-1120|219-09-9999)$"), "iban": _value(country, IBANS) == F.length(plain),
        "local_phone": digits.rlike("^[2-9][0-8][0-9][2-9][0-9]{6}$") & ~digits.rlike("^(?:.11|...[0-9]11)"), "credential": ~F.lower(span).rlike(PLACEHOLDERS) & ~span.rlike(r"^(.)\1+$"),
        "person": ~F.element_at(F.split(span, " "), -1).isin(NO_FAMILY), "address": ~span.rlike("^0"),
    }, F.lit(False))
    bounds = ~F.col("before").rlike(r"[\p{L}\p{N}]$") & ~F.col("after").rlike(r"^[\p{L}\p{N}]")
    around = F.lower(F.concat(F.coalesce("before", F.lit("")), F.lit(" "), F.coalesce("after", F.lit(""))))
    ahead = F.lower(F.coalesce("before", F.lit("")))
    cue = _of({k: (ahead if k in ("credential", "person") else around).rlike(c) for k, c in CUES.items()}, F.lit(False))
    votes = dict(zip(VOTES, (fits, known, bounds, cue), strict=True))
    share = lambda x: F.least(F.floor(4.0 * x / F.length(span)), F.lit(3)).cast("int")
    before = F.right(F.col("before"), F.lit(1))
    shapes = {
        "length": F.least(F.floor(F.log2(F.length(span).cast("double"))), F.lit(7)).cast("int"), "digits": share(F.length(digits)), "variety": share(signs),
        "lead": F.when(before == "", 0).when(before.rlike(r"\s"), 1).when(before.rlike("[\"'(<\\[]"), 2).when(before.rlike("[:=]"), 3).otherwise(4),
    }
    own = {v: F.when(F.col("kind").isin(*SILENT.get(v, ("",))), ABSTAINS).when(F.col("kind").isNotNull(), F.coalesce(c, F.lit(False)).cast("int")) for v, c in votes.items()}
    return spans.withColumns(own | {k: F.when(F.col("kind").isNotNull(), F.coalesce(c, F.lit(0)).cast("int")) for k, c in shapes.items()})


def _value(key: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def reliabilities(table: list[tuple], rounds: int = 200) -> tuple[list[float], dict[str, float], list[tuple[float, float]]]:
    """(the probability that each row of votes is personal, the share of each kind, hit and false-alarm rate of each
    labeler) by expectation-maximisation of the two-class model in which labelers err apart. table: (kind, *votes, count);
    a vote of ABSTAINS tells nothing."""
    kinds, n = sorted({r[0] for r in table}), len(VOTES)
    if not table:
        return [], {}, [(0.8, 0.3)] * n
    given, count = np.array([r[1 : n + 1] for r in table]), np.array([r[-1] for r in table], float)
    votes, against = (given == 1).astype(float), (given == 0).astype(float)
    kind = np.array([kinds.index(r[0]) for r in table])
    prior, hit, false = np.full(len(kinds), 0.5), np.full(n, 0.8), np.full(n, 0.3)
    told = lambda rate: np.exp(votes @ np.log(rate) + against @ np.log(1 - rate))
    for _ in range(rounds):
        yes, no = prior[kind] * told(hit), (1 - prior[kind]) * told(false)
        belief = yes / (yes + no)
        of_kind = lambda x: np.bincount(kind, x, len(kinds))
        prior = (1 + of_kind(count * belief)) / (2 + of_kind(count))
        sure, other = count * belief, count * (1 - belief)
        hit = np.clip((0.8 + sure @ votes) / (1 + sure @ (votes + against)), 1e-3, 1 - 1e-3)
        false = np.clip((0.3 + other @ votes) / (1 + other @ (votes + against)), 1e-3, 1 - 1e-3)
    return belief.tolist(), dict(zip(kinds, prior.tolist(), strict=True)), list(zip(hit.tolist(), false.tolist(), strict=True))


def train_classifier(table: list[tuple], belief: list[float], names: tuple[str, ...], rounds: int = 30, ridge: float = 1.0) -> dict[tuple, float]:
    """Logistic regression of the beliefs by Newton's steps on the table of counts (*values, count): the weight of each
    (name, value) that occurs."""
    keys = sorted({(n, v) for r in table for n, v in zip(names, r, strict=False)}, key=str)
    if not keys:
        return {}
    place = {k: i for i, k in enumerate(keys)}
    x = np.zeros((len(table), len(keys)))
    for i, r in enumerate(table):
        for n, v in zip(names, r, strict=False):
            x[i, place[n, v]] = 1
    count, q, w = np.array([r[-1] for r in table], float), np.array(belief), np.zeros(len(keys))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (count * (q - p)) - ridge * w
        curve = (x * (count * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(keys))
        step = np.linalg.solve(curve, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return {k: float(w[i]) for k, i in place.items()}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(row_id, id, kind, start, end, base, probability) of all spans, and a row without kind for each text without any.

    Base spans, matches of the four base kinds that pass their checks, are always given. Matches of other kinds are added
    if the classifier's probability is at least threshold and they overlap no base span; of added ones that overlap, those
    go that come after another by start, length (longest first) and order of kinds. Matches of base kinds that fail are
    counted in training, as what labelers disagree on, and never given. Reliabilities are estimated from how often each
    combination of votes occurs for each kind, over all candidates; the classifier is trained on those beliefs, with votes
    and shapes as features. The counts of all these are at most 11 * 81 * 640, whatever the corpus, and are fitted on the
    driver; the classifier is then one expression. Null and empty texts have no span. row_id tells repeated rows apart. A
    very long text is searched whole. Other columns are ignored. Only DataFrame functions are used on rows.
    """
    spans, _ = stored(labelled(candidates(docs, id_col, text_col)).drop("span", "before", "after"), "spans")
    names = ("kind", *VOTES, *SHAPES)
    table = sorted(tuple(r) for r in spans.filter("kind is not null").groupBy(*names).count().collect())  # bounded by the values of its columns
    voted: dict[tuple, int] = {}
    for r in table:
        voted[r[:5]] = voted.get(r[:5], 0) + r[-1]
    rows = sorted((*k, n) for k, n in voted.items())
    belief = dict(zip([r[:-1] for r in rows], reliabilities(rows)[0], strict=True))
    weights = train_classifier(table, [belief[r[:5]] for r in table], names)
    z = F.lit(0.0)
    for name in names:
        own = F.lit(0.0)
        for (n, v), w in weights.items():
            own = F.when(F.col(name) == v, w).otherwise(own) if n == name else own
        z = z + own
    scored = spans.withColumn("probability", 1 / (1 + F.exp(-z))).withColumn("base", F.coalesce(F.col("kind").isin(*BASE) & (F.col("format") == 1), F.lit(False)))
    nth = _of({k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(99))
    scored = scored.withColumn("order", nth)
    by_row = Window.partitionBy("row_id").orderBy("start", F.col("end").desc(), "order")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by_row.rowsBetween(0, Window.unboundedFollowing))
    apart = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    added = F.col("kind").isNotNull() & ~F.col("kind").isin(*BASE) & (F.col("probability") >= threshold) & apart
    scored = scored.withColumn("added", F.coalesce(added, F.lit(False)))
    taken = F.max(F.when(F.col("added"), F.col("end"))).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    given = scored.withColumn("given", F.col("base") | (F.col("added") & (F.coalesce(taken, F.lit(0)) <= F.col("start"))))
    given = given.withColumn("n", F.sum(F.col("given").cast("int")).over(Window.partitionBy("row_id"))).withColumn("nth", F.row_number().over(by_row))
    kept = given.filter("given or n = 0 and nth = 1")
    null = lambda c: F.when(F.col("given"), F.col(c)).alias(c)
    return kept.select("row_id", "id", null("kind"), null("start"), null("end"), F.col("base") & F.col("given"), null("probability")).toDF("row_id", "id", "kind", "start", "end", "base", "probability")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of find_personal's rows."""
    nth = _of({k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(99))
    item = F.struct("start", nth.alias("nth"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE]
    return found.groupBy("row_id", "id").agg(*counts, F.sha2(joined(F.when(F.col("base"), item)), 256).alias("base_sha256"), joined(F.when(F.col("kind").isNotNull(), item)).alias("spans"), F.count("kind").alias("n_spans")).select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans")
