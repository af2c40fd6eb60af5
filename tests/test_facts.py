import random
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

import replay
from kbcurate.functions import dates as D
from kbcurate.operators import facts as R
from kbcurate.session import shared_dir

FACT = ("id string, politician_id string, type string, value string, value_precision int, entity_id string, "
        "st string, sp int, et string, ep int, created_at long, deleted_at long")


def day(rng, levels=(9, 10, 11)):
    p = rng.choice(levels)
    return (p, rng.choice([2000, 2001, 2002]), rng.choice([1, 2]) if p >= 10 else None,
            rng.choice([1, 2]) if p >= 11 else None)


def frame(rng, levels=(9, 10, 11)):
    roll = rng.random()
    if roll < 0.1:
        return (None, None)
    return (None if roll < 0.2 else day(rng, levels), None if roll > 0.75 else day(rng, levels))


def fact_table(spark, facts):
    rows = []
    for i, (who, kind, entity, value) in enumerate(facts):
        date = value if kind == "P569" else None
        s, e = value if kind == "P39" else (None, None)
        rows.append((f"f{i:04d}", who, kind, replay.time(date), date and date[0], entity,
                     replay.time(s), s and s[0], replay.time(e), e and e[0], i, None))
    df = spark.createDataFrame(rows, FACT)
    return df.withColumn(
        "qualifiers_json",
        D.term_qualifiers(D.imprecise(F.col("st"), F.col("sp")), D.imprecise(F.col("et"), F.col("ep"))),
    )


def candidate_table(spark, cands):
    rows = [(who, "src", i, kind, entity,
             replay.text(value) if kind == "P569" else None,
             replay.text(value[0]) if kind == "P39" else None,
             replay.text(value[1]) if kind == "P39" else None, ["q"])
            for i, (who, kind, entity, value) in enumerate(cands)]
    df = spark.createDataFrame(
        rows, "politician_id string, source_id string, seq long, kind string, entity_id string, value string, "
        "start_date string, end_date string, supporting_quotes array<string>")
    return R.candidate_rows(df).valid


def accepts(cand, fact):
    if cand[:3] != fact[:3]:
        return False
    if cand[1] == "P569":
        return replay.same(cand[3], fact[3]) and not replay.finer(cand[3], fact[3])
    return cand[1] != "P39" or replay.accepted_term(cand[3], fact[3])


def world(seed, n_facts, n_cands, people=4):
    rng = random.Random(seed)

    def one(levels):
        kind = rng.choice(["P569", "P39", "P39", "P39", "P27"])
        who = f"p{rng.randrange(people)}"
        if kind == "P569":
            return (who, kind, None, day(rng, levels))
        if kind == "P39":
            return (who, kind, rng.choice(["E1", "E2"]), frame(rng, levels))
        return (who, kind, rng.choice(["N1", "N2"]), None)

    return ([one((8, 9, 10, 11)) for _ in range(n_facts)],
            [one((9, 10, 11)) for _ in range(n_cands)])


def test_matching_agrees_with_all_pairs(spark):
    facts, cands = world(1, 120, 300)
    table = candidate_table(spark, cands)
    got = {r.seq: r.fact_id for r in table.join(
        R.match_facts(table, fact_table(spark, facts)), "cand_id").select("seq", "fact_id").collect()}
    for i, c in enumerate(cands):
        want = next((f"f{j:04d}" for j, f in enumerate(facts) if accepts(c, f)), None)
        assert got.get(i) == want, (c, want)


def test_candidates_are_parsed_once(spark):
    """What is matched joins written candidates; their texts are not parsed again for it."""
    facts, cands = world(1, 20, 20)
    out = R.match_facts(candidate_table(spark, cands), fact_table(spark, facts))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_subsumption_agrees_with_walking_the_terms(spark):
    rng = random.Random(3)
    facts = [(f"p{i % 25}", "P39", "E1", ((9, 2000 + k, None, None), (9, 2001 + k, None, None) if k < 2 or i % 2 else None))
             for i in range(25) for k in range(3)]
    facts += [(f"p{rng.randrange(25)}", "P39", "E1", frame(rng)) for _ in range(20)]
    facts += facts[::7]  # copies
    cands = [(f"p{rng.randrange(25)}", "P39", "E1", frame(rng, (9, 10))) for _ in range(300)]
    table = candidate_table(spark, cands)
    told = R.subsumed(table, fact_table(spark, facts))
    got = {r.seq for r in table.join(told, "cand_id", "left_semi").collect()}
    want = {i for i, c in enumerate(cands)
            if replay.told(c[3], [f[3] for f in facts if f[:3] == c[:3]])}
    assert got == want and want


def test_only_the_last_of_equal_terms_goes_on(spark):
    facts = [("p0", "P39", "E1", ((9, 2000, None, None), (9, 2005, None, None)))] * 4
    facts += [("p0", "P39", "E1", ((9, 2006, None, None), None))]
    blocks = spark.createDataFrame([("p0", "E1")], "politician_id string, place string")
    chains = R.chain_ends(R._office_terms(fact_table(spark, facts), blocks)).collect()
    assert sum(r.weight for r in chains) == 5 and sum(r.gap * r.weight for r in chains) == 4
    assert sum(r.weight for r in chains if r.chain_end is None) == 2


def sequential(facts, cands):
    known = [(f"f{i:04d}", f) for i, f in enumerate(facts)]
    out = {}
    for i, c in enumerate(cands):
        hit = next((fid for fid, f in known if accepts(c, f)), None)
        if hit is None and c[1] == "P39" and replay.told(c[3], [f[3] for _, f in known if f[:3] == c[:3]]):
            out[i] = None
            continue
        if hit is None:
            hit = f"new{i}"
            known.append((hit, c))
        out[i] = hit
    return out


def check_merge(spark, facts, cands):
    table = candidate_table(spark, cands).persist()
    refs = spark.createDataFrame([], "property_id string, source_id string, supporting_quotes array<string>")
    merged = R.merge_extractions(fact_table(spark, facts), refs, table)
    by_cand = {r.cand_id: r.seq for r in table.select("cand_id", "seq").collect()}
    new = {r.property_id: f"new{by_cand[r.cand_id]}" for r in table.select(
        "cand_id", R.new_fact_id(F.col("cand_id")).alias("property_id")).collect()}
    got = {by_cand[r.cand_id]: new.get(r.property_id, r.property_id) for r in merged.assigned.collect()}
    got.update({by_cand[r.cand_id]: None for r in merged.dropped.collect()})
    want = sequential(facts, cands)
    assert got == want
    assert merged.new_facts.count() == len({v for v in want.values() if v and v.startswith("new")})
    assert merged.references.count() == len({v for v in want.values() if v})


def test_merge_agrees_with_one_by_one_replay(spark):
    facts, cands = world(11, 60, 400, people=3)
    check_merge(spark, facts, cands)


def test_merge_reconsiders_a_dropped_term_after_the_state_changed(spark):
    def year(y):
        return (9, y, None, None)

    who = ("p0", "P39", "E1")
    facts = [(*who, (year(2000), year(2001))), (*who, (year(2001), year(2003)))]
    wide = (*who, (year(2000), year(2003)))
    cands = [wide, (*who, ((10, 2000, 5, None), (10, 2003, 2, None))), wide, wide]
    assert sequential(facts, cands) == {0: None, 1: "new1", 2: "new1", 3: "new1"}
    check_merge(spark, facts, cands)


def test_merge_asks_for_copies_beyond_those_at_hand(spark, monkeypatch):
    """With one copy at hand, later ones are asked for in rounds, with the same outcome."""
    facts, cands = world(12, 30, 250, people=2)
    check_merge(spark, facts, cands)
    monkeypatch.setattr(R, "COPIES", 1)
    monkeypatch.setattr(R, "_settle_terms", counted := Counted(R._settle_terms))
    check_merge(spark, facts, cands)
    assert counted.n == 1


class Counted:
    def __init__(self, f):
        self.f, self.n = f, 0

    def __call__(self, *args):
        self.n += 1
        return self.f(*args)


def test_offices_are_settled_over_batches():
    def value(who, seq):
        row = dict(politician_id=who, place="E1", kind="value", vkey=f"v{seq}", seq=seq, after=None, copies=None,
                   sp=9, sy=2000 + seq, sm=0, sd=0, ep=None, ey=None, em=None, ed=None,
                   cand_id=f"c{seq}", seqs=[seq], cand_ids=[f"c{seq}"], more=False)
        return row

    rows = [value("p0", 0), value("p0", 1), value("p0", 2), value("p1", 3)]
    batches = [pd.DataFrame(rows[:2]), pd.DataFrame(rows[2:])]
    frames = list(R._settle_offices(iter(batches)))
    assert len(frames) == 1
    assert [(r.politician_id, r.outcome, r.owner) for r in frames[0].itertuples()] == [
        ("p0", "new", "c0"), ("p0", "new", "c1"), ("p0", "new", "c2"), ("p1", "new", "c3")]


def test_all_pairs_of_facts_are_compared(spark):
    from kbcurate.plans import fact_queries  # noqa: F401
    from kbcurate.plans.registry import QUERIES
    from kbcurate.plans.views import Catalog

    folder = "/root/testdata/sf0.001"
    pairs = Catalog.of(spark, folder).v_date_pairs
    bce = {r["k"] for r in pairs.where("asign = '-'").select("k").collect()}
    got = [r["k"] for r in QUERIES["compare_all_facts"](spark, folder).collect()]
    assert bce and bce <= set(got) and len(got) == pairs.count()


def test_a_merge_reads_each_step_once_and_keeps_no_finished_one(spark):
    facts, cands = world(5, 40, 60)
    folder = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    refs = spark.createDataFrame([], "property_id string, source_id string, supporting_quotes array<string>")
    merged = R.merge_extractions(fact_table(spark, facts), refs, candidate_table(spark, cands))
    steps = {p.name.split("-")[0] for p in set(folder.glob("*")) - before}
    assert "judged" in steps and not steps & {"values", "filed"}
    assert {Path(f).parent.name.split("-")[0] for f in merged.assigned.inputFiles()} == {"judged", "placed"}


def test_bins_that_no_start_can_share_are_left_out(spark):
    facts = [("p0", "P39", "E1", ((11, 2000, 5, 7), None)), ("p1", "P39", "E1", ((9, 2000, None, None), None))]
    view = R.fact_view(fact_table(spark, facts))

    def bins(others):
        return sorted(map(tuple, R._start_bins(view, ["politician_id"], stored=True, others=others).collect()))

    assert [k for _, k in bins([11])] == ["a=11:20000507", "a=9:2000", "b<9:2000"]
    assert [k for _, k in bins([9])] == ["a<9:2000", "a=11:20000507", "a=9:2000"]
    assert len(bins(None)) > 6 and set(bins([9, 10, 11])) < set(bins(None))
