"""Claims of notes against what was said: language checks, verdicts with all their reasons, reports, evaluation, extraction comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spoken
from ..functions import text as T

#: Phrases that commit and that defer, and who says that they or another will do a thing.
COMMITMENT = [
    r"\bagree(?:d|s)?\b", r"\bgo ahead\b", r"\blet'?s (?:do|go|proceed|lock)\b", r"\block (?:that|it|this) in\b", r"\bhappy to proceed\b", r"\bproceed with\b",
    r"\bwe'?ll (?:set up|put|move|switch|increase|reduce|start|lodge|renew|make|go|get|update|proceed)\b", r"\bdo it\b", r"\bsign(?:ed)? off\b", r"\bdecided\b", r"\bgo with\b",
]
DEFERRAL = [
    r"\bthink about\b", r"\bnot yet\b", r"\bnext time\b", r"\bnext review\b", r"\bhold off\b", r"\bpark (?:that|it|this)\b", r"\brevisit\b", r"\bnot ready\b", r"\bsleep on it\b",
    r"\bcome back to\b", r"\bleave (?:it|that) for now\b", r"\bno rush\b", r"\bnot sure\b", r"\bmaybe later\b", r"\bdefer\b", r"\bnot today\b",
]
ADVISER_WILL = r"\b(?:i'?ll|i will|i can|i'?m going to|let me)\b"
ADVISER_ASKS = r"\b(?:could you|can you|if you could|you'?ll need to|please send|you send|would you)\b"
CLIENT_WILL = r"\b(?:i'?ll|i will|we'?ll|we will|sure|yes|i can)\b"
PARAPLANNER_WILL = r"\b(?:i'?ll|i will|i can)\b"
PARAPLANNER_NAMED = r"\bparaplanner\b.*\bwill\b"
#: Words without content in notes, terms of advice, and terms that alone make no advice.
STOP = """
a an the and or of to in on at for with by from is are was were be been has have had will
would could should this that these those it its as per about now new next also may might
than then there their they them we our you your i me my he she his her him who what which
when where how all any some such no not only own same so too very can just do does did done
into over under up down out off again further once here more most other than
client clients adviser advisers discussed agreed agree noted note meeting year years month
months approximately around following currently previously expects expected wants want like
one two three get got going go make made confirmed confirm still
""".split()
DOMAIN = """
super superannuation pension contribution concessional non-concessional cap caps salary
sacrifice bring-forward insurance cover premium premiums life tpd income protection fee fees
platform advice risk profile balanced growth conservative portfolio portfolios investment invest
option fund funds retire retirement retiring mortgage inheritance estate probate dependant
dependants beneficiary nomination binding death benefit centrelink age consent statement
disclosure soa roa fact-find fact goal goals budget deposit emergency school job employer
promotion role salary wage hours work health surgery hospital medical baby child children
spouse partner bereavement bereaved depression hearing language writing paperwork capacity
understanding vulnerability review appointment follow-up switch switching product compare
comparison underwriting drawdown assets asset tax taxed lodge claim renewal renew level
northshore licensee related conflict conflicts related-party volatility return returns
""".split()
GENERIC = "goal goals review statement appointment plan".split()
#: Who must have said a claim of a section.
SPEAKERS = {"decisions": ["client", "adviser"], "goals": ["client", "adviser"], "circumstance_changes": ["client", "adviser"], "vulnerability_indicators": ["client"]}
WORD = "[a-z][a-z'-]*[a-z]|[a-z]"


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns)


#: A light stem by the first rule that fits: shortest length, ending, letters cut, letters put in their place.
STEMS = [(6, "ing", 3, ""), (5, "ies", 3, "y"), (5, "ed", 2, ""), (4, "ses", 2, ""), (4, "xes", 2, ""), (4, "zes", 2, ""), (4, "ss", 0, ""), (4, "s", 1, "")]


def stem_sql(w: str) -> str:
    """The stem of ``w`` as SQL that either engine reads."""
    rules = [f"WHEN length({w}) >= {least} AND {w} LIKE '%{end}' THEN concat(substr({w}, 1, length({w}) - {cut}), '{put}')" for least, end, cut, put in STEMS]
    return f"CASE {' '.join(rules)} ELSE {w} END"


def stem(w: str) -> str:
    rule = next((r for r in STEMS if len(w) >= r[0] and w.endswith(r[1])), (0, "", 0, ""))
    return w[: len(w) - rule[2]] + rule[3]


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def content_words(text: str) -> Column:
    """Distinct stems of the words with content in the column ``text``; number words are figures, not words."""
    bare = f"transform(regexp_extract_all(lower({text}), r\"{WORD}\", 0), w -> regexp_replace(w, r\"'s$\", ''))"
    kept = f"filter({bare}, w -> length(w) > 2 AND w NOT IN ({_listed([*STOP, *spoken.NUMBER_WORDS])}))"
    return F.expr(f"array_distinct(transform({kept}, w -> {stem_sql('w')}))")


def content_sql(text: str) -> str:
    bare = f"list_transform(regexp_extract_all(lower({text}), '{WORD.replace(chr(39), chr(39) * 2)}'), lambda w: regexp_replace(w, '''s$', ''))"
    kept = f"list_filter({bare}, lambda w: length(w) > 2 AND w NOT IN ({_listed([*STOP, *spoken.NUMBER_WORDS])}))"
    return f"list_distinct(list_transform({kept}, lambda w: {stem_sql('w')}))"


#: Stems that make advice.
ADVICE = sorted({stem(w) for w in DOMAIN} - {stem(w) for w in GENERIC})


def implied_owner(role: Column, text: Column) -> Column:
    """Whom one segment says will do the thing; null where it does not say."""
    t = F.lower(text)
    adviser = F.when(T.matches(t, ADVISER_ASKS), "client").when(T.matches(t, PARAPLANNER_NAMED), "paraplanner").when(T.matches(t, ADVISER_WILL), "adviser")
    return F.when(role == "paraplanner", F.when(T.matches(t, PARAPLANNER_WILL), "paraplanner")).when(role == "adviser", adviser).when((role == "client") & T.matches(t, CLIENT_WILL), "client")


def verdicts(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """A verdict per claim (``meeting_id, section, idx, text, owner, due, evidence``) against the cited segments (``meeting_id, seg_id, role, text``).

    Hard reasons (a citation or figure or date that is not there, a decision nobody took, another owner, small talk) make a claim unsupported; little
    overlap does too, some overlap or a wrong speaker makes it weak. ``reasons`` are codes, hard ones first.
    """
    cited = claims.select("meeting_id", "section", "idx", F.posexplode("evidence").alias("k", "seg_id"))
    said = segments.select("meeting_id", "seg_id", "role", F.col("text").alias("said"))
    s = cited.join(said, ["meeting_id", "seg_id"], "left").withColumn("there", F.col("said").isNotNull())
    commits, defers = T.matches(F.col("said"), any_of(COMMITMENT)), T.matches(F.col("said"), any_of(DEFERRAL))
    allowed = F.lit(False)
    for section, roles in SPEAKERS.items():
        allowed = allowed | ((F.col("section") == section) & F.col("role").isin(roles))
    per = s.groupBy("meeting_id", "section", "idx").agg(
        F.count_if(~F.col("there")).alias("unknown"), F.count_if("there").alias("known"), F.coalesce(F.bool_or(F.when(F.col("there"), allowed)), F.lit(False)).alias("speaker"),
        F.coalesce(F.bool_or(commits & ~defers), F.lit(False)).alias("committed"), F.coalesce(F.bool_or(defers), F.lit(False)).alias("deferred"), F.collect_set(implied_owner(F.col("role"), F.col("said"))).alias("owners"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("k", "said")))), lambda x: x["said"]), " ").alias("said"),
    )
    c = claims.join(per, ["meeting_id", "section", "idx"], "left").na.fill({"unknown": 0, "known": 0, "said": ""})
    c = c.withColumn("claimed", F.concat_ws(" due ", "text", F.col("due").cast("string"))).withColumn("own", content_words("text")).withColumn("theirs", content_words("said"))
    c = c.withColumn("n_claim", spoken.numbers_in("claimed")).withColumn("n_said", spoken.numbers_in("said")).withColumn("d_claim", spoken.dates_in("claimed")).withColumn("d_said", spoken.dates_in("said"))
    lex = F.when(F.size("own") == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("own", "theirs")) / F.size("own"))
    agrees = lambda a: F.exists("d_said", lambda b: spoken.agree(a, b))
    terms = F.array(*[F.lit(w) for w in ADVICE])
    some, off = F.col("known") > 0, (F.size(F.array_intersect(F.col("own"), terms)) == 0) & (F.size(F.array_intersect(F.col("theirs"), terms)) == 0)
    hard = [
        (F.col("unknown") > 0, "unknown_segment"), ((F.col("known") == 0) & (F.col("unknown") == 0), "no_evidence"), (some & (F.size(F.array_except("n_claim", "n_said")) > 0), "figure"), (some & F.exists("d_claim", lambda a: ~agrees(a)), "date"),
        (some & (F.col("section") == "decisions") & ~F.col("committed") & F.col("deferred"), "deferral"), (some & (F.col("section") == "decisions") & ~F.col("committed") & ~F.col("deferred"), "no_commitment"),
        (some & (F.col("section") == "action_items") & (F.size("owners") > 0) & ~F.array_contains("owners", F.col("owner")), "owner"), (some & (F.col("section") != "follow_up") & off, "off_topic"),
    ]
    c = c.withColumn("lex", lex).withColumn("hard", F.array_compact(F.array(*[F.when(w, F.lit(r)) for w, r in hard])))
    wrong = F.col("section").isin(list(SPEAKERS)) & ~F.col("speaker")
    bad, o = F.size("hard") > 0, F.col("lex")
    status = F.when(bad | (o < 0.25), "unsupported").when((o < 0.5) | wrong, "weak").otherwise("supported")
    score = F.when(bad, F.lit(0.0)).when(o < 0.25, 0.5 * o).when((o < 0.5) | wrong, 0.5 + 0.3 * o).otherwise(0.7 + 0.3 * o)
    reasons = F.when(bad, F.col("hard")).when(o < 0.25, F.array(F.lit("overlap"))).when(wrong, F.array(F.lit("speaker"))).when(o < 0.5, F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>"))
    return c.select("meeting_id", "section", "idx", status.alias("status"), F.round(F.least(F.lit(1.0), score), 4).alias("score"), reasons.alias("reasons"), "n_claim")


def applied(claims: DataFrame, found: DataFrame) -> DataFrame:
    """``claims`` with ``unsupported`` set by the verdicts, except where a person edited the claim."""
    new = found.select("meeting_id", "section", "idx", (F.col("status") == "unsupported").alias("new"))
    return claims.join(new, ["meeting_id", "section", "idx"], "left").withColumn("unsupported", F.when(F.col("edited") | F.col("new").isNull(), F.col("unsupported")).otherwise(F.col("new"))).drop("new")


def report(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Per meeting the verdicts by status, the supported share (1 without claims) and the share of the note's figures that anybody said."""
    said = segments.select("meeting_id", F.explode(spoken.numbers_in("text")).alias("n")).distinct()
    noted = found.select("meeting_id", F.explode("n_claim").alias("n")).distinct().join(said.withColumn("there", F.lit(True)), ["meeting_id", "n"], "left")
    figures = noted.groupBy("meeting_id").agg(F.count("*").alias("figures"), F.count_if(F.col("there").isNull()).alias("ungrounded"))
    counts = found.groupBy("meeting_id").agg(F.count("*").alias("claims"), *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "weak", "unsupported")])
    both = counts.join(figures, "meeting_id", "left").na.fill({"figures": 0, "ungrounded": 0})
    share = F.coalesce(F.try_divide("supported", "claims"), F.lit(1.0))
    return both.select("meeting_id", "claims", "supported", "weak", "unsupported", F.round(share, 4).alias("supported_share"), "figures", "ungrounded", F.round(1 - F.coalesce(F.try_divide("ungrounded", "figures"), F.lit(0.0)), 4).alias("grounding"))


#: The fields whose match makes an extracted record right.
CRITICAL = ("adviser_name", "advice_date", "risk_profile", "fee_initial", "fee_ongoing", "recommendations")


def compared(both: DataFrame, fields: list[str], critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Per record the booleans ``ok_<field>`` of ``both``, whether it is right (all critical ones), and its share of right fields."""
    ok = [F.col(f"ok_{f}") for f in fields]
    right = F.lit(True)
    for f in critical:
        right = right & F.col(f"ok_{f}")
    share = sum((c.cast("int") for c in ok[1:]), ok[0].cast("int")) / F.lit(len(ok))
    return both.select("doc_id", *ok, right.alias("doc_correct"), F.round(share, 6).alias("field_accuracy"))
