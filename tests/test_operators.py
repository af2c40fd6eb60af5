import datetime
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from kbcurate.functions import claims as C, dates as D, text as X
from kbcurate.operators import curation as V, entities as E, hierarchy as H, importer as I, pages as P, ranks, search as S, stats as A
from kbcurate.sources.dump import clean_lines, parse_entities
from kbcurate.sources.tables import upsert


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def item(qid, rank=None, sid="s"):
    rank = f'"rank":"{rank}",' if rank else ""
    return f'{{"id":"{sid}",{rank}"mainsnak":{{"datavalue":{{"type":"wikibase-entityid","value":{{"id":"{qid}"}}}}}}}}'


def test_lines_that_are_no_entities_are_dropped(spark):
    df = parse_entities(lines(spark, "[", ' {"id":"Q1","labels":[]}, \r', "", '{"id":"Q2"', "{}", '{"id":"Q3"}', "]"))
    assert sorted(r.id for r in df.collect()) == ["Q1", "Q3"]


def test_truthy_claims_by_rank(spark):
    claims = ",".join([item("Q1", "deprecated"), item("Q2"), item("Q3", "preferred"), '{"mainsnak":{}}'])
    plain = ",".join([item("Q1", "deprecated"), item("Q2"), item("Q4", "normal")])
    df = parse_entities(lines(
        spark, f'{{"id":"A","claims":{{"P31":[{claims}]}}}}', f'{{"id":"B","claims":{{"P31":[{plain}]}}}}',
        '{"id":"C","claims":[]}'))
    got = {r.id: list(r.c) for r in df.select("id", C.class_ids(F.col("claims")).alias("c")).collect()}
    assert got == {"A": ["Q3"], "B": ["Q2", "Q4"], "C": []}


def test_every_office_passes_when_none_is_known(spark):
    df = parse_entities(lines(spark, f'{{"id":"A","claims":{{"P39":[{item("Q7")}],"P27":[{item("Q8")}]}}}}'))
    none = spark.createDataFrame([], "wikidata_id string")
    some = spark.createDataFrame([("Q9",)], "wikidata_id string")
    assert [r.type for r in I.politician_properties(df, none, none, none).collect()] == ["P39"]
    assert I.politician_properties(df, some, none, none).collect() == []


def test_closure_ends_on_diamonds_and_cycles(spark):
    ids = spark.createDataFrame([(x,) for x in "ABCDEF"], "wikidata_id string")
    pairs = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("D", "Z"), ("E", "F")]
    edges = spark.createDataFrame([(p, c, "P279") for p, c in pairs], "parent_entity_id string, child_entity_id string, relation_type string")
    assert sorted(r[0] for r in H.descendants(ids, edges, ["A", "missing"]).collect()) == list("ABCDZ")
    assert H.descendants(ids, edges, []).collect() == []


def test_upsert_keeps_soft_deletes_and_takes_the_last_of_a_batch(spark):
    stored = spark.createDataFrame([("a", "old", 9), ("b", "old", None), (None, "x", None)], "id string, name string, deleted_at int")
    batch = spark.createDataFrame([("a", "n1", 1), ("a", "n2", 2), ("c", "n3", 1), (None, "y", 1)], "id string, name string, seq int")
    got = {(r.id, r.name, r.deleted_at) for r in upsert(stored, batch, ["id"], ["name"], ["seq"]).collect()}
    assert got == {("a", "n2", 9), ("b", "old", None), ("c", "n3", None), (None, "x", None), (None, "y", None)}
    kept = {(r.id, r.name) for r in upsert(stored, batch, ["id"], []).collect()}
    assert ("a", "old") in kept


def replayed(log):
    created, act = False, None
    for action in log:
        if action == "create":
            created = True
        elif action == "reject" and created:
            created = False
        elif act == action:
            act = None
        else:
            act = action
    return ({"create"} if created else set()) | ({act} if act else set())


def test_folded_actions_agree_with_replay(spark):
    rng = random.Random(2)
    logs = {f"i{k}": (["create"] if rng.random() < 0.4 else []) + [rng.choice(["accept", "reject"]) for _ in range(rng.randrange(1, 8))]
            for k in range(200)}
    rows = [("p", i, n, a) for i, log in logs.items() for n, a in enumerate(log)]
    got = defaultdict(set)
    for r in V.fold_actions(spark.createDataFrame(rows, "politician_id string, id string, seq int, action string")).collect():
        got[r.id].add(r.action)
    assert all(got[i] == replayed(log) for i, log in logs.items())


def test_qualifiers_become_rest_values(spark):
    q = ('{"P1":[{"snaktype":"value","datavalue":{"type":"wikibase-entityid","value":{"id":"Q5"}}}],'
         '"P2":[{"snaktype":"value","datavalue":{"type":"string","value":"a \\"b\\""}}],'
         '"P3":[{"snaktype":"somevalue"}],"P4":[{"snaktype":"value","datavalue":{"type":"quantity","value":{"amount":"+1"}}}]}')
    got = spark.createDataFrame([(q,)], "q string").select(V.rest_qualifiers(F.col("q"))).first()[0]
    assert got == ('[{"property":{"id":"P1"},"value":{"type":"value","content":"Q5"}},'
                   '{"property":{"id":"P2"},"value":{"type":"value","content":"a \\"b\\""}},'
                   '{"property":{"id":"P3"},"value":{"type":"somevalue"}},'
                   '{"property":{"id":"P4"},"value":{"type":"value","content":{"amount":"+1"}}}]')


def test_spread_rank_is_row_number(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, id int").withColumn("tie", ranks.tie_break("id"))
    got = ranks.spread_rank(df, ["k"], {"v": F.col("v"), "t": F.substring("tie", 1, 1)}, [F.col("tie")], "rank")
    by_key = defaultdict(list)
    for r in got.orderBy("rank").collect():
        by_key[r.k].append((r["rank"], r.v, r.tie))
    for seen in by_key.values():
        assert [r for r, _, _ in seen] == list(range(1, len(seen) + 1))
        assert [x[1:] for x in seen] == sorted(x[1:] for x in seen)


def test_gather_gives_one_row_per_key_whatever_its_size(spark):
    df = spark.createDataFrame([("hot", i) for i in range(7000)] + [("cold", 1)], "k string, i int").repartition(5)
    rows = {r.k: r["items"] for r in ranks.gather(df, ["k"], F.col("i"), "items").collect()}
    assert rows == {"hot": list(range(7000)), "cold": [1]}


def test_page_text(spark):
    html = ("<!DOCTYPE html><title>T&amp;lt;</title><script>no()</script><!-- no --><p>a<b>b</b>&nbsp;c &eacute;&#233;&#xe9; &bogus; x & y</p>")
    more = ['<a title="x > y">z</a>', "&copy 2020 &eacute! &notit; &#65 b &amp", "a<script>lost", "a <b title='q>w' y=\"1\"", "1 < 2 <b c='>d"]
    rows = [(h,) for h in [html, "<p> </p>", *more]]
    got = spark.createDataFrame(rows, "h string").select(X.page_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == [
        "T&lt; a b c ééé &bogus; x & y", "", "z", "© 2020 é! ¬it; A b &", "a", "a w' y=\"1\"", "1 < 2 d",
    ]


def test_nested_infobox(spark):
    text = ("{{redirect|x}} {{Infobox person|a={{b|{{c|{{d}}}}}}|birth_date={{birth date|df={{yes}}|1970|1|2}}"
            "|birth_place=[[Rome]], {{flag|{{x}}|IT}}}} tail {{Infobox other|birth_date=1 2 1930}}")
    rows = [(text,), ("{{infobox|birth_date=3 4 1950}}",), ("{{Infobox open|birth_date=1 1 1900",), ("none",)]
    boxed = spark.createDataFrame(rows, "w string").select(X.infobox(F.col("w")).alias("b"))
    got = boxed.select("b", X.birth_place(F.col("b")).alias("p"), X.birth_date(F.col("b")).alias("d")).collect()
    assert got[0].b.endswith("|IT}}") and got[0].p == "Rome, {{flag|{{x}}|IT}}"
    assert (got[1].b, got[1].d) == ("|birth_date=3 4 1950", "3 4 1950")
    assert [r.b for r in got[2:]] == [None, None]


def test_infobox_fields_are_split_once(spark):
    text = "{{Infobox x|birth_date={{birth date|3|4|1950|df=y}}|birth_place=[[Rome]]<!-- z -->}}"
    pages = spark.createDataFrame([(1, text), (2, "none")], "page_id long, wikitext string")
    births = P.infobox_births(pages)
    assert [(r.page_id, r.birth_date, r.birth_place) for r in births.collect()] == [(1, "3 4 1950", "Rome")]
    assert births._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # box, fields


def test_time_frames_are_parsed_once(spark):
    texts = spark.createDataFrame([(None,), ('{"P580":[{"datavalue":{"value":{"time":"+1999-00-00T00:00:00Z","precision":9}}}]}',)], "q string")
    shown = texts.select(D.shown_timeframe(F.col("q")).alias("t"))
    assert [r.t for r in shown.collect()] == ["", " (1999 - present)"]
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_narrow_tables_are_put_in_parts(spark, tmp_path, monkeypatch):
    from kbcurate.plans import views

    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(views, "ROWS_PER_TASK", 10)
    assert views.Catalog(spark, str(tmp_path)).table("part").rdd.getNumPartitions() == 5


def test_shared_folder_is_asked_for_on_a_cluster():
    from kbcurate.session import one_process

    assert [one_process(m) for m in ("local", "local[8]", "local-cluster[2,1,512]", "spark://h:1", "yarn")] == [True, True, False, False, False]


def test_filter_options_chosen_that_do_not_exist_take_no_slot(spark):
    from kbcurate.operators import stats

    options = spark.createDataFrame([(f"v{i}", f"l{i}", i + 1) for i in range(9)], "value string, label string, count int")
    assert stats.filter_options(options, None, ["v0", "gone", "away"]).count() == 6


def test_facts_without_statement_are_no_imported_facts(spark):
    from kbcurate.operators import stats

    people = spark.createDataFrame([("p1", "A", "Q1")], "id string, name string, wikidata_id string")
    facts = spark.createDataFrame(
        [("f1", "p1", "P27", "Q9"), ("f2", "p2", "P27", "Q9")], "id string, politician_id string, type string, entity_id string"
    ).withColumns({c: F.lit(None).cast("string") for c in ("value", "statement_id", "qualifiers_json", "references_json", "deleted_at")}).withColumn(
        "value_precision", F.lit(None).cast("int"))
    entities = spark.createDataFrame([("Q9", "Land")], "wikidata_id string, name string")
    sources = spark.createDataFrame([(f"s{i}", "u") for i in range(5500)], "id string, url string").withColumns(
        {c: F.lit(None).cast("string") for c in ("url_hash", "fetch_timestamp", "status", "error", "http_status_code")})
    refs = sources.select(F.lit("f1").alias("property_id"), F.col("id").alias("source_id"), F.array(F.lit("q")).alias("supporting_quotes"))
    own = spark.createDataFrame([("p1", "s1"), ("p2", "s2")], "politician_id string, source_id string")
    out = stats.politician_documents(people, facts, entities, refs, sources, own)
    assert [(r.id, [p.entity_name for p in r.properties]) for r in out.politicians.collect()] == [("p1", ["Land"])]
    assert out.references.count() == 5500 and [r.politician_id for r in out.sources.collect()] == ["p1"]


def test_quotes_cross_element_boundaries(spark):
    html = "<p>The <b>old</b>man<i>s</i> hat</p><p>Next   line. The oldman</p><script>the old</script>"
    df = spark.createDataFrame([(html,)], "h string").select(X.quote_stream(F.col("h")).alias("s"))
    stream = df.first().s
    cases = {"the old": 2, "the oldman": 2, "the old man": 1, "mans hat": 1, "man s hat": 1, "hat next line": 1,
             "hatnext line": 1, "nextline": 0, "thehat": 0, "": 0}
    assert {q: X.find_quote(stream, q)[0] for q in cases} == cases


def test_permanent_link(spark):
    rows = [
        ('<li id="t-permalink"><a class="x" href="https://e/?a=1&amp;oldid=2">p</a></li>',), ("<a href='x'>y</a>",),
        ("<li id='t-permalink'></li><a href='x'>y</a>",), ("<li class=c id=t-permalink><a href='z'>y</a></li>",),
        ('<li id="t-permalink"><a name="n">y</a><a href="x">y</a></li>',), ('<li id="t-permalink-2"><a href="x">y</a></li>',),
    ]
    got = spark.createDataFrame(rows, "h string").select(X.permanent_url(F.col("h")).alias("u")).collect()
    assert [r.u for r in got] == ["https://e/?a=1&oldid=2", None, None, "z", None, None]


def test_hybrid_search_is_exact_over_blocks(spark):
    rng = np.random.default_rng(1)
    docs = [(f"d{i:03d}", [f"name {i}", "ring" if i % 9 == 0 else "rod"], rng.normal(size=6).tolist()) for i in range(90)]
    asked = [(f"q{i}", "ring", rng.normal(size=6).tolist()) for i in range(5)]
    got = S.find_similar_hybrid(
        spark.createDataFrame(asked, "query_id string, query string, vector array<double>"),
        spark.createDataFrame(docs, "wikidata_id string, labels array<string>, vector array<double>"),
        0.4, 7, docs_per_block=20, queries_per_block=2)
    found = defaultdict(list)
    for r in got.orderBy("rank").collect():
        found[r.query_id].append(r.wikidata_id)
    for qid, text, q in asked:
        def score(d):
            cosine = np.dot(q, d[2]) / (np.linalg.norm(q) * np.linalg.norm(d[2]))
            keyword = max([len(text) / len(t) for t in d[1] if text in t] or [0])
            return round(0.6 * keyword + 0.4 * (1 + cosine) / 2, 6)

        assert found[qid] == [d[0] for d in sorted(docs, key=lambda d: (-score(d), d[0]))][:7]


def test_filter_options_are_blind_to_accents(spark):
    df = spark.createDataFrame([("a", "Côte", 1), ("b", "cotton", 5), ("c", "Mali", 9)], "value string, label string, count int")
    assert [r.value for r in A.filter_options(df, "cot").collect()] == ["b", "a"]
    assert [r.value for r in A.filter_options(df, None, ["a"], target=2).collect()] == ["a", "c"]


def test_first_dump_collects_nothing(spark):
    dumps = spark.sql("SELECT 'd1' AS id, TIMESTAMP '2024-01-01' AS last_modified")
    table = spark.sql("SELECT 'Q1' AS wikidata_id, TIMESTAMP '2020-01-01' AS updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at, 's' AS statement_id")
    seen = table.where("false")
    out = V.run_gc(dumps, table, table, table, seen, seen, F.current_timestamp())
    assert out.index_deletes.collect() == []
    two = dumps.union(spark.sql("SELECT 'd2', TIMESTAMP '2024-01-02'"))
    assert len(V.run_gc(two, table, table, table, seen, seen, F.current_timestamp()).index_deletes.collect()) == 1


def test_fields_nest_to_any_depth(spark):
    from kbcurate.functions import text as X

    deep = "{{a|{{b|{{c|{{d|{{e|{{f|x}}}}}}}}}}}}"
    cases = [
        (f"person|birth_date={deep}|birth_place=[[Rome|the [[city]]]], {deep} <!-- | birth_place = no -->|name=z", f"the [[city, {deep}"),
        ("person| BIRTH_PLACE = { one } [x] ", "{ one } [x]"),
        ("person|note={{cite|birth_place=wrong}}|birth_place=right", "right"),
        ("person|birth_place=|name=z", None), ("person", None), ("person|xbirth_place=no", None),
        ("person|birth_place=a = b", "a = b"),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, b string")
    got = {r.i: r for r in df.select("i", X.birth_place(F.col("b")).alias("p"), X._field(F.col("b"), "birth_date").alias("d")).collect()}
    assert got[0].d == deep and got[0].p.endswith(deep)
    assert [got[i].p for i in range(1, len(cases))] == [p for _, p in cases[1:]]


def test_accents_of_all_letters(spark):
    import unicodedata

    from kbcurate.operators import stats as A

    letters = [chr(c) for a, b in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for c in range(a, b)
               if unicodedata.category(chr(c)).startswith("L")]

    def plain(x):
        return "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ").lower()

    rows = [(c, unicodedata.normalize("NFD", c), plain(c)) for c in letters]
    got = spark.createDataFrame(rows, "c string, d string, p string").select(
        "p", A.plain_text(F.col("c")).alias("c"), A.plain_text(F.col("d")).alias("d"), F.lower("p").alias("l")
    ).collect()
    assert all(r.c == r.l == r.d for r in got), [r for r in got if not r.c == r.l == r.d][:5]
    df = spark.createDataFrame([("a", "Việt Nam", 1), ("b", unicodedata.normalize("NFD", "Việt Minh"), 2)], "value string, label string, count int")
    assert [r.value for r in A.filter_options(df, "viet").collect()] == ["b", "a"]
    assert [r.value for r in A.filter_options(df, "VIỆT n").collect()] == ["a"]


def test_review_places_in_steps_like_together(spark, monkeypatch):
    """A politician with very many facts is placed in steps, with the same places."""
    from kbcurate.operators import stats as A
    from kbcurate.plans.views import Catalog

    facts = Catalog.of(spark, "/root/testdata/sf0.001").v_properties
    together = sorted(map(tuple, A.review_sections(facts).collect()))
    monkeypatch.setattr(A, "HEAVY", 12)
    assert sorted(map(tuple, A.review_sections(facts).collect())) == together
    monkeypatch.setattr(A, "HEAVY", 0)
    assert sorted(map(tuple, A.review_sections(facts).collect())) == together


def test_quotes_of_whole_pages_letter_by_letter(spark):
    """Every quote of the fixture against a pattern that allows a mark for a space or between letters."""
    import re

    from kbcurate.operators import pages as P
    from kbcurate.plans.fact_queries import quote_fixture
    from kbcurate.plans.views import Catalog

    c = Catalog.of(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in c.table("documents").select("doc_id", "text").collect()}
    refs, pages = quote_fixture(c)
    rows = P.verify_quotes(refs, pages).collect()
    hits = 0
    for r in rows:
        stream = re.sub(r"\n+", "\x01", re.sub(r"\n*[ \t\r\x0b\x0c\xa0]+[ \t\r\x0b\x0c\xa0\n]*", " ", texts[r.source_id])).lower().strip(" \x01")
        words = re.sub(r"\s+", " ", r.quote).strip().lower()
        pattern = "".join("[ \x01]" if x == " " else re.escape(x) + "\x01?" for x in words[:-1]) + re.escape(words[-1:])
        found = [m.start() + 1 for m in re.finditer(pattern.replace("\x01?[ \x01]", "[ \x01]"), stream)] if words else []
        assert (r.hits, r.first_at) == (len(found), found[0] if found else 0), (r.source_id, r.quote[:60])
        hits += r.hits
    assert hits > len(texts)


def test_very_many_quotes_of_one_page(spark):
    from kbcurate.operators import pages as P

    words = [f"word{i}" for i in range(3000)]
    pages = spark.createDataFrame([(1, "<p>" + " ".join(words) + "</p>"), (2, "<p>not quoted</p>")], "source_id long, html string")
    quotes = [f"{a} {b}" for a, b in zip(words, words[1:])] + ["", "  ", "absent"]
    refs = spark.createDataFrame([(1, 1, quotes), (2, 1, quotes[:5]), (3, 7, ["no page"])], "property_id long, source_id long, supporting_quotes array<string>")
    got = P.verify_quotes(refs, pages).collect()
    assert len(got) == len(quotes) + 6 and sum(r.hits for r in got) == 2999 + 5


def test_items_in_any_form(spark):
    """The usual form of an item is cut out of its text, and a date is read once; others are read as JSON."""
    values = [
        (1, '{"id":"Q5"}', "Q5"), (2, '{"entity-type":"item","numeric-id":5,"id":"Q5"}', "Q5"), (3, '{"id":"a\\"b"}', 'a"b'),
        (4, '{"id":""}', ""), (5, '{"id":"L1-F1","x":{"id":"no"}}', "L1-F1"), (6, '{"x":{"id":"no"}}', None), (7, "text", None),
        (8, None, None),
    ]
    claim = F.struct(F.struct(F.struct(F.lit("time").alias("type"), F.col("v").alias("value")).alias("datavalue")).alias("mainsnak"))
    rows = spark.createDataFrame(values, "k int, v string, want string").select("k", "want", C.claim_entity(claim).alias("got"))
    assert [r["got"] for r in rows.orderBy("k").collect()] == [w for *_, w in values]
    usual = spark.createDataFrame(values[:2], "k int, v string, want string").select(C.claim_date(claim).alias("d"))
    plan = usual._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.time") == 1


def test_lines_are_cut_at_their_ends(spark):
    lines = ["[", "]", " ", "", "\t[\r", "a,", " a, ", "a,,", ",", "a , b", "\u00a0a,", "a\r\n", None]
    got = [r[0] for r in clean_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got == ["a", "a", "a,", "", "a , b", "\u00a0a", "a"]


def test_politicians_are_found_without_a_broadcast(spark):
    def line(qid, job, offices=(), human="Q5"):
        held = ",".join(item(o) for o in offices)
        return f'{{"id":"{qid}","labels":[],"sitelinks":{{"w1wiki":{{"title":"{qid}"}}}},"claims":{{"P31":[{item(human)}],"P106":[{item(job)}],"P39":[{held}]}}}}'

    people = parse_entities(lines(spark, line("Q1", "Q82955"), line("Q2", "Q1", ["Q70", "Q71", "Q71"]), line("Q3", "Q1", ["Q72"]),
                                  line("Q4", "Q1"), line("Q5", "Q82955", ["Q70"], human="Q6"), line("Q6", "Q82955", ["Q70", "Q72"])))
    positions = spark.createDataFrame([("Q70",), ("Q71",), ("Q71",)], "wikidata_id string")
    chosen = I.is_politician(people, positions).select("id")
    assert sorted(r.id for r in chosen.collect()) == ["Q1", "Q2", "Q6"]
    stored = spark.createDataFrame([("own", "Q2")], "id string, wikidata_id string")
    projects = spark.createDataFrame([("W1", "https://w1.wikipedia.org/")], "wikidata_id string, official_website string")
    none = positions.limit(0)
    links = I.import_politicians(people, F.lit("2024-01-31").cast("timestamp"), positions, none, none, projects, stored).links
    ids = {r.url[-2:]: r.politician_id for r in links.collect()}
    assert sorted(ids) == ["Q1", "Q2", "Q6"] and ids["Q2"] == "own"
    assert "BroadcastHashJoin" not in chosen._jdf.queryExecution().executedPlan().toString()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin [prefix") == plan.count("BroadcastHashJoin")
