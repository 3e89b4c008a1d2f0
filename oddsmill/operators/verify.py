"""

A pair gets a code: ``1`` same proposition, ``inv`` inverted leg, ``br`` same event with other criteria, ``0`` different, empty for
not reviewed. Verdicts by series are data, in a rule table; the rest are column expressions and one Arrow similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import near_words

# Verdicts by series.
ACCEPT = """KXWCGOAL KXWCAST KXPGATOP5 KXPGATOP10 KXPGATOP20 KXPGATOUR KXEUROVISIONRANK KXEUROVISIONTELEV KXFOMEN KXFOWOMEN KXSURVIVOR
KXCHESSNORWAY KXIPL KXNCAABASEBALL KXNBAMVP KXNHLADAMS KXNHLNORRIS KXNHLCALDER KXNHLHART KXNHLVEZINA KXNBACOY KXTOPSONG KXTOPALBUM
KXBBCHARTPOSITIONSONG KXMETGALAFITS KXFARRERBYELECTION KXDAEGUMAYOR KXNEWARKMAYOR KXSEOULMAYOR KXCOPPAITALIA KXFACUP KXCOUPEDEFRANCE
KXSERIEATOP4 KXBUNDESLIGATOP4 KXLIGAMX KXDFBPOKAL KXIIHF KXVALORANT KXCS2 KXCS2QUALIFIERS KXEPLRELEGATION KXLALIGARELEGATION
KXBUNDESLIGARELEGATION KXSERIEARELEGATION KXLEMANS24H KXINDYCARRACE KXNEXTHUNGARYPM KXVANCEPAKISTAN KXKNESSET KXFABLERESTORE KXSENATEREC
KXDASHORDERS KXPLTR KXPSKY KXMLBALLSTAR KXNBADRAFT1 KXNHLDRAFTPICK KXWCROUND KXSPACEXCOUNT KXPERUPRESMATCHUP KXCA04PRIMARY KXCA22PRIMARY
KXLARSENR1 KXATTENDTRUMPCHINA KXNHLSERIESSCORE KXEPLTOTAL KXBUNDESLIGATOTAL KXEPLBTTS KXMLSBTTS KXSERIEABTTS KXLALIGABTTS KXLIGUE1BTTS
KXBUNDESLIGABTTS KXCFLGAME KXISLGAME KXLNBELITEGAME KXPREMCHAMP KXLOLMAP KXVALORANTMAP KXCS2MAP KXATPSETWINNER KXWTASETWINNER KXWCGROUPWIN
KXTRUMPCHINA KXVANCEMENTION KXMRBEASTMENTION KXLAMAYOR1ROUND KXNBAFINMVP KXNBAWFINMVP KXNBAEFINMVP KXUCLBTTS KXUECLBTTS KXUELBTTS
KXNBA""".split()
REJECT = """KXEUROVISION KXEUROVISIONJURY KXWCMOV KXWCSTAGEOFELIM KXWCBTTS KXWCGROUPBOTTOM KXUFCMOV KXUFCVICROUND KXUFCMOF KXUFCDISTANCE
KXPERUPRES KXMAYORLA KXWCGSGOALS KXWCGOALCOUNT KXWCGOALCOMBO KXWCGOALSALLOWED KXWCTEAM1STGOAL KXTEAMSINNCAABBWS KXTEAMSINNBAWF
KXNHLSERIESGAMES KXNBASERIESGAMES KXNHLTOTAL KXPGAMAKECUT KXWTAADVANCE KXATPADVANCE KXARBROATHBY KXABERDEENSOUTHBY KXMAKERFIELDBY KXGREENMAYOR
KXIPLGAME KXMENWORLDCUP KXCOLOMBIAPRES KXCOLOMBIAPRESR1 KXCPICORE KXNHLPLAYOFFGOALS KXLEADERUCLGOALS KXUCL KXWCFTTS KXWCFURTHESTADVANCING
KXVOTEPRIMARY KXLAMAYORADVANCE KXCBRATEHIKE KXDOTA2GAME KXATPGSPREAD KXNBASERIES3PMLEADER KXLLM1 KXNBA2D KXATPGRANDSLAMFIELD KXFEATUREDRAKE
KXTRYFIREPOWELL KXAGNOMCOD KXGOVGANOMR KXGOVOKNOMR KXNVPRIMARY KXARGPREMDIVBTTS KXPERUPRES1R""".split()
BASIS_RISK = """KXFABLERESTORE KXRT KXGOVNMNOMR KXGOVNMNOMD KXGOVSCNOMD KXGOVSCNOMR KXGOVALNOMR KXGOVALNOMD KXGOVORNOMR KXGOVOHNOMR KXGOVMDNOMR
KXGOVNENOMR KXGOVGANOMD KXAGNOMTXR KXVOTEFEDCHAIR KXTRAVISKELCEWEDDING KXSCOTPARLIAMENT KXWALESPARLIAMENT""".split()
FIXTURES = "KXEPLBTTS KXMLSBTTS KXSERIEABTTS KXLALIGABTTS KXLIGUE1BTTS KXBUNDESLIGABTTS KXUCLBTTS KXUECLBTTS KXUELBTTS KXEPLTOTAL KXBUNDESLIGATOTAL KXWCGROUPWIN".split()
NOMINEE = r"^KX(NY\d+D|SENATE\w+|KXSENATE\w+|[A-Z]{2}\d*PRIMARY|PA\d+D|PA07D|CO\d+[DR]|NE2[DR]|UT1D|KY4R|ME02D|IA02R|MD06D|TX33D|TX18D|SC01R|NJ07D|OH9R|MTPRIMARY|NY\d+D)$"
WEATHER, ANIME = r"^KX(HIGH|LOW|MIN|MAX)", r"^KXANIME"
# A word that the first venue's title must hold, by series.
TITLE_WORDS = {"KXTRUMPCHINA": "visit", "KXNBAWFINMVP": "western", "KXNBAEFINMVP": "eastern", "KXNBAFINMVP": "finals mvp"}
METRIC_WORDS = {"KXWCGOAL": "goal", "KXWCAST": "assist"}
# Words that say nothing about a subject, and words that name a sport.
STOP = "the a an of in at for to and or vs will be win wins won by on".split()
GENERIC_CLUB = "fc sc cf ac afc cd club city united town athletic real deportivo".split()
SPORT_WORDS = {
    "cricket": ("cricket", "test series", "odi", "t20", "wickets"),
    "soccer": ("soccer", "fifa", "premier league", "la liga", "bundesliga", "serie a", "ligue 1", "mls", "uefa", "goals"),
    "basketball": ("basketball", "nba", "euroleague"),
    "hockey": ("hockey", "nhl", "iihf"),
    "baseball": ("baseball", "mlb", "innings"),
    "tennis": ("tennis", "atp", "wta", "set 1", "grand slam"),
    "golf": ("golf", "pga", "tee", "the cut"),
    "football": ("nfl", "touchdown", "quarterback"),
}
# The pattern that names both teams, and the level from which words are near.
TEAMS = r"(?i)^If (.+?) and (.+?) both score"
NEAR = 85.0
#: Letters with marks that have a plain form, and combining marks (built from the Unicode tables).
_MARKED, _PLAIN = "", ""


def _accents() -> tuple[str, str]:
    import unicodedata

    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) > 1 and len(stripped := "".join(c for c in base if not unicodedata.combining(c))) == 1:
            marked.append(chr(code))
            plain.append(stripped)
    return "".join(marked), "".join(plain)


def strip_accents(text: Column) -> Column:
    """[V1] Latin letters without their marks."""
    global _MARKED, _PLAIN
    if not _MARKED:
        _MARKED, _PLAIN = _accents()
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARKED, _PLAIN), r"[̀-ͯ]", "")


def norm_tokens(text: Column) -> Column:
    """[V1] Words of letters a-z and digits, without stop words."""
    words = F.split(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP))


def subject_ok(subtitle: Column, title: Column, outcomes: Column) -> Column:
    """[V3] The last telling word of the subtitle, and half of all, must be in the title or outcomes; true without telling words."""
    telling = F.filter(norm_tokens(subtitle), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$"))
    hay = F.array_distinct(F.concat(norm_tokens(title), norm_tokens(F.array_join(F.coalesce(outcomes, F.array().cast("array<string>")), " "))))
    hits = near_words(telling, hay, NEAR)
    share = F.try_divide(F.size(F.filter(hits, lambda x: x)).cast("double"), F.size(hits))
    return (F.size(telling) == 0) | (F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(False)) & F.coalesce(share >= 0.5, F.lit(False)))


def fixture_ok(title: Column, description: Column, rules: Column) -> Column:
    """[V4] Both teams that the rules name share a telling word with the other side; true where they name none."""
    text = F.trim(F.coalesce(rules, F.lit("")))
    hay = F.array_distinct(F.concat(norm_tokens(title), norm_tokens(description)))
    ok = F.lit(True)
    for group in (1, 2):
        words = F.filter(norm_tokens(F.regexp_extract(text, TEAMS, group)), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC_CLUB))
        ok = ok & ((F.size(words) == 0) | F.exists(near_words(words, hay, NEAR), lambda x: x))
    return ok


def sports_of(text: Column) -> Column:
    """[V5]"""
    plain = F.lower(strip_accents(text))
    named = []
    for sport, words in SPORT_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(plain, F.lit(w))
        named.append(F.when(hit, sport))
    return F.array_compact(F.array(*named))


def sports_conflict(a: Column, b: Column) -> Column:
    """[V5] Both texts name sports, and none in common."""
    x, y = sports_of(a), sports_of(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def orientation(outcomes: Column, leg: Column, subtitle: Column) -> Column:
    """[V6] ``na`` for yes/no outcomes, else whether the subtitle speaks of the leg (same), of the other (inverse), or neither."""
    low = F.transform(outcomes, F.lower)
    plain = (low == F.array(F.lit("yes"), F.lit("no"))) | (low == F.array(F.lit("no"), F.lit("yes")))
    sub = norm_tokens(subtitle)

    def share(text: Column) -> Column:
        own = F.array_distinct(norm_tokens(text))
        return F.size(F.array_intersect(own, sub)) / F.greatest(F.size(own), F.lit(1))

    ours, theirs = share(F.get(outcomes, leg)), share(F.get(outcomes, 1 - leg))
    return (
        F.when(plain, "na")
        .when(F.size(outcomes) != 2, "unclear")
        .when((ours >= 0.6) & (theirs < ours), "same")
        .when((theirs >= 0.6) & (ours < theirs), "inverse")
        .otherwise("unclear")
    )


def rule_table(spark) -> DataFrame:
    """[V9] series, verdict: a rejection before basis risk before acceptance."""
    rows = {s: "accept" for s in ACCEPT} | {s: "basis_risk" for s in BASIS_RISK} | {s: "reject" for s in REJECT}
    return spark.createDataFrame(sorted(rows.items()), "series string, verdict string")


def _has(text: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word))


def decide(pairs: DataFrame) -> DataFrame:
    """[V7] pairs with code and oriented, from pairs(pm_id, k_id, series, k_sub, k_title, k_rules, pm_title, pm_desc, pm_outcomes, pm_leg).

    The rule table is a fixed list of series and is broadcast.
    """
    t, s = F.col("pm_title"), F.col("series")
    rows = pairs.join(F.broadcast(rule_table(pairs.sparkSession)), "series", "left")
    rows = rows.withColumns({
        "_orient": orientation(F.col("pm_outcomes"), F.col("pm_leg"), F.col("k_sub")),
        "_subject": subject_ok(F.col("k_sub"), t, F.col("pm_outcomes")),
        "_fixture": ~s.isin(FIXTURES) | fixture_ok(t, F.col("pm_desc"), F.col("k_rules")),
        "_sports": sports_conflict(F.concat_ws(" ", "pm_title", "pm_desc"), F.concat_ws(" ", "k_title", "k_rules")),
    })
    award = norm_tokens(F.regexp_extract(F.lower(F.coalesce("k_title", F.lit(""))), r"award for (.+?)\??$", 1))
    anime = (F.size(award) > 0) & (F.size(F.array_except(award, norm_tokens(t))) == 0)
    worded = F.lit(True)
    for series, word in TITLE_WORDS.items():
        worded = worded & ((s != series) | _has(t, word))
    metric = F.lit(True)
    for series, word in METRIC_WORDS.items():
        metric = metric & ((s != series) | _has(t, word))
    checked = worded & F.col("_subject") & F.col("_fixture") & ~F.col("_sports")
    accepted = (F.coalesce(F.col("verdict") == "accept", F.lit(False))) | s.rlike(WEATHER) | s.rlike(NOMINEE)
    reached = _has(t, "usa reach") & _has(F.col("k_title"), "not make")
    plain = F.when(F.col("_orient") == "inverse", "inv").when(F.col("_orient") == "unclear", "").otherwise("1")
    code = (
        F.when(~metric | (s == "KXSPACEXCOUNT"), "0")
        .when(s == "KXWCUSAOPPONENT", F.when(reached, "inv").otherwise("0"))
        .when(s == "KXLAMAYOR1R", F.when(~_has(t, "finish second") & F.col("_subject"), "1").otherwise("0"))
        .when(s == "KXATTENDUFC250", F.when(F.col("_subject"), "1").otherwise("0"))
        .when(F.col("verdict") == "reject", "0")
        .when(F.col("verdict") == "basis_risk", F.when(checked, "br").otherwise("0"))
        .when(s.rlike(ANIME), F.when(anime & checked, plain).otherwise("0"))
        .when(accepted, F.when(checked, plain).otherwise("0"))
        .otherwise("")
    )
    same = F.when(F.col("_orient") == "na", "same").otherwise(F.col("_orient"))
    oriented = F.when(F.col("code") == "inv", "inverse").when((F.col("code") == "1") & s.isin("KXLAMAYOR1R", "KXATTENDUFC250"), "same").when(F.col("code").isin("1", "br"), same).otherwise("")
    return rows.withColumn("code", code).withColumn("oriented", oriented).drop("verdict", "_orient", "_subject", "_fixture", "_sports")


def apply_verdicts(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[D6] matches with verified, orientation and basis_risk set by the codes 1, inv and br."""
    use = verdicts.where(F.col("code").isin("1", "inv", "br")).select("pm_id", "k_id", "code")
    out = matches.join(use, ["pm_id", "k_id"], "left")
    return out.select(
        *(c for c in matches.columns if c not in ("verified", "orientation", "basis_risk")),
        (F.col("verified") | F.col("code").isNotNull()).alias("verified"),
        F.when(F.col("code").isNull(), F.col("orientation")).when(F.col("code") == "inv", "inverse").otherwise("same").alias("orientation"),
        F.when(F.col("code").isNull(), F.col("basis_risk")).otherwise(F.col("code") == "br").alias("basis_risk"),
    )


def sheet_orientation(outcomes: Column, leg: Column, subtitle: Column, title: Column) -> Column:
    """[V8] As V6 for two named outcomes, over all words of subtitle (else title) and title, none left out and accents as breaks."""

    def plain(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 ]+", " "), " +"), lambda w: w != ""))

    subject = F.array_union(plain(F.coalesce(F.nullif(subtitle, F.lit("")), title)), plain(title))
    share = lambda own: F.size(F.array_intersect(own, subject)) / F.greatest(F.size(own), F.lit(1))
    low = F.transform(outcomes, F.lower)
    yes_no = (low == F.array(F.lit("yes"), F.lit("no"))) | (low == F.array(F.lit("no"), F.lit("yes")))
    ours, theirs = share(plain(F.get(outcomes, leg))), share(plain(F.get(outcomes, 1 - leg)))
    return F.when(yes_no | (F.size(outcomes) != 2), "na").when((ours >= 0.6) & (theirs < ours), "same").when((theirs >= 0.6) & (ours < theirs), "inverse").otherwise("unclear")


def review_sheet(pairs: DataFrame, length: int = 220) -> DataFrame:
    """[V8] The columns a reviewer reads, with the rules cut to a readable length and the leg's outcome named."""
    leg = F.get("pm_outcomes", F.col("pm_leg"))
    oriented = sheet_orientation(F.col("pm_outcomes"), F.col("pm_leg"), F.col("k_sub"), F.col("k_title"))
    return pairs.select("pm_id", "k_id", "series", "pm_title", "pm_outcomes", "pm_leg", leg.alias("pm_leg_outcome"), "k_title", "k_sub", oriented.alias("orientation"), F.substring("pm_desc", 1, length).alias("pm_desc"), F.substring("k_rules", 1, length).alias("k_rules"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """[A28] Pairs per series and code."""
    return verdicts.groupBy("series", "code").agg(F.count(F.lit(1)).alias("n"))
