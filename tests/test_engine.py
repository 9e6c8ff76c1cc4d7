import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.engine import Config, Engine
from quarry.operators import codes, evaluate, sync
from quarry.operators.filters import Filters
from quarry.sources import imports

PRODUCTS = [
    ("p1", "Drill driver", "Bosch", "GSB-13-RE", "060114E600", "3165140371940", 100.0),
    ("p2", "Vacuum cleaner", "Bosch", "BOSCH-06", None, None, 200.0),
    ("p3", "Heater", "Acme", "HW-1234K", "44556677", None, None),
]
SCHEMA = "external_id string, name string, brand string, article string, product_code string, ean13 string, price double"


def ts(s):
    return F.lit(s).cast("timestamp")


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "store"))
    e.upsert(spark.createDataFrame(PRODUCTS, SCHEMA), ts("2024-01-01 00:00:00"))
    return e


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    e = Engine.open(spark, str(tmp_path_factory.mktemp("store")))
    e.upsert(spark.createDataFrame(PRODUCTS, SCHEMA), ts("2024-01-01 00:00:00"))
    return e


def hits(engine, spark, *queries, **options):
    out = engine.search(spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id int, query string"), **options)
    return [tuple(r) for r in out.orderBy("query_id", "bucket", "rank").select("query_id", "external_id", "tier").collect()]


@pytest.mark.parametrize("token, product, tier", [
    ("gsb-13.re", "p1", "exact"), ("B0SCH-O6", "p2", "exact_normalized"), ("3165140371941", "p1", "ean_corrected"), ("3165140317940", "p1", "ean_corrected"),
])
def test_strong_codes_answer_alone(ready, spark, token, product, tier):
    assert hits(ready, spark, token) == [(0, product, tier)]


def test_fuzzy_and_text(ready, spark):
    got = hits(ready, spark, "GSB-13-RF", "vacuum cleaner")
    assert (0, "p1", "fuzzy") in got and [g for g in got if g[0] == 1][0][1] == "p2"


def test_short_circuit_stays_empty_under_filters(ready, spark):
    assert hits(ready, spark, "GSB-13-RE", filters=Filters(brand="acme")) == []


def test_strict_mode(ready, spark):
    r = ready.search(spark.createDataFrame([(0, "bosch vacuum hdmi")], "query_id int, query string"), strict=True)
    got = {x["external_id"]: (x["bucket"], x["missing_terms"]) for x in r.collect()}
    assert got["p2"] == ("alternatives", "hdmi") and "p3" not in got


def test_rerank_needs_a_reranker(ready, spark):
    with pytest.raises(ValueError):
        hits(ready, spark, "x", rerank=True)


def test_upsert_refresh_patch_archive_delete(engine, spark):
    same = spark.createDataFrame([("p1", "old", None, None, None, None, 1.0), ("p1", "Drill driver", "Bosch", "GSB-13-RE", "060114E600", "3165140371940", None)], SCHEMA).coalesce(1)
    assert engine.upsert(same, ts("2024-02-01 00:00:00")).count() == 2
    row = engine.store.read().where("external_id = 'p1'").first()
    assert row["price"] is None and row["name"] == "Drill driver" and engine.stats().first()["total"] == 3
    rep = {r[0]: r[1] for r in engine.update_prices(spark.createDataFrame([("p1", 5.0), ("zz", 1.0)], "external_id string, price double"), ts("2024-02-02 00:00:00")).collect()}
    assert rep == {"p1": True, "zz": False} and engine.store.read().where("external_id = 'p1'").first()["price"] == 5.0
    ids = spark.createDataFrame([("p2",)], "external_id string")
    engine.set_archived(ids, True, ts("2024-02-02 00:00:00"))
    assert tuple(engine.stats().first()) == (3, 2, 1) and all(h[1] != "p2" for h in hits(engine, spark, "BOSCH-06"))
    snapshot = spark.createDataFrame([("p1",), ("new",)], "external_id string")
    with pytest.raises(sync.TooManyOrphans):
        engine.reconcile(snapshot, ts("2024-03-01 00:00:00"), ts("2024-03-01 00:00:00"), max_archived=0)
    assert [r[0] for r in engine.reconcile(snapshot, ts("2024-03-01 00:00:00"), ts("2024-03-01 00:00:00"), dry_run=False).collect()] == ["p3"]
    assert {tuple(r) for r in engine.diff(snapshot).collect()} == {("new", "missing_in_index"), ("p2", "extra_in_index"), ("p3", "extra_in_index")}
    assert [r[1] for r in engine.delete(ids).collect()] == [True] and engine.stats().first()["total"] == 2


def test_schema_guard(engine, spark):
    with pytest.raises(sync.SchemaMismatchError):
        Engine.open(spark, engine.store.path, Config(embedder="other"))


def test_import_csv_and_json(engine, spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,Назва,ціна,Гарантія\nc1,  Тест  один ,10,2 роки\nc2,,5,\nc3,x,-1,\n", encoding="utf-8")
    done, bad = engine.import_file(str(tmp_path / "a.csv"), ts("2024-01-02 00:00:00"))
    assert [r[0] for r in done.collect()] == ["c1"]
    assert [r["error"] for r in bad.collect()] == ["name: missing", "price: below zero"]
    row = engine.store.read().where("external_id = 'c1'").first()
    assert row["name"] == "Тест один" and row["price"] == 10.0 and row["attributes"]["Гарантія"]["s"] == "2 роки"
    (tmp_path / "a.json").write_text('{"id": 1}')
    with pytest.raises(imports.UnsupportedFile):
        imports.read_rows(spark, str(tmp_path / "a.json"))
    with pytest.raises(imports.UnsupportedFile):
        imports.read_rows(spark, "a.TXT")


def test_sheet(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.XLSX", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>x1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    df = imports.read_rows(spark, str(tmp_path / "a.XLSX"))
    assert df.columns == ["id"] and [r[0]["s"] for r in df.collect()] == ["x1"]


def test_active_sheet_and_its_kinds(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda cells: f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="rId1"/><sheet name="b" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row><c t="inlineStr"><is><t>wrong</t></is></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row><c t="inlineStr"><is><t>id</t></is></c><c t="inlineStr"><is><t>volt</t></is></c><c t="inlineStr"><is><t>ok</t></is></c></row><row><c><v>7</v></c><c><v>18</v></c><c t="b"><v>1</v></c></row>'))
    row = imports.map_columns(imports.read_rows(spark, str(tmp_path / "b.xlsx"))).first()
    assert row["external_id"] == "7" and row["attributes"]["volt"]["n"] == 18.0 and row["attributes"]["ok"]["b"] is True


def test_json_attributes_keep_their_kinds(engine, spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "j1", "name": "one", "attributes": {"voltage": 18, "color": "red", "safe": true}, "Weight": 1.5, "color": "blue"},'
                                     ' {"id": "j2", "name": "two", "attributes": {"deep": {"a": 1}}}, {"id": 3, "name": "three", "voltage": "18", "price": 5}]', encoding="utf-8")
    done, bad = engine.import_file(str(tmp_path / "a.json"), ts("2024-01-02 00:00:00"))
    assert {tuple(r)[:2] for r in done.collect()} == {("j1", True), ("3", True)} and [r["error"] for r in bad.collect()] == ["attributes.deep: not a plain value"]
    got = {r["external_id"]: {k: (v["t"], v["n"] if v["t"] == "n" else v["b"] if v["t"] == "b" else v["s"]) for k, v in r["attributes"].items()} for r in engine.store.read().where("external_id in ('j1', '3')").collect()}
    assert got == {"j1": {"voltage": ("n", 18.0), "color": ("s", "red"), "safe": ("b", True), "Weight": ("n", 1.5)}, "3": {"voltage": ("s", "18")}}
    asked = spark.createDataFrame([(0, "one two three")], "query_id int, query string")
    assert [r["external_id"] for r in engine.search(asked, filters=Filters(attributes={"voltage": 18})).collect()] == ["j1"]


def test_direct_rows_are_checked(engine, spark):
    rows = [("d1", "  A   b ", "x" * 200, None), (" d2 ", "N", "br", "EAN 40-06"), ("d3", " ", None, None)]
    report = engine.upsert(spark.createDataFrame(rows, "external_id string, name string, brand string, ean13 string"), ts("2024-01-05 00:00:00"))
    assert {tuple(r) for r in report.collect()} == {("d1", False, "brand: too long"), ("d2", True, None), ("d3", False, "name: missing")}
    assert tuple(Engine.summary(report).first()) == (3, 1, 2)
    assert engine.store.read().where("external_id = 'd2'").select("name", "ean13", "embed_model").first() == ("N", "4006", "hash-64")


def test_options_of_each_request(ready, spark):
    asked = spark.createDataFrame(
        [(0, "ＧＳＢ－１３－ＲＥ", None, None, None, None), (1, "", None, None, None, None), (2, "bosch vacuum", 1, None, None, None), (3, "bosch vacuum hdmi", None, "strict", None, None), (4, "drill vacuum heater", None, None, 150.0, None), (5, "bosch", None, None, None, "acme")],
        "query_id int, query string, limit int, mode string, price_min double, brand string",
    )
    got = {}
    for r in ready.search(asked).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert [(r["external_id"], r["tier"], r["matched_field"], r["reranked"]) for r in got[0]] == [("p1", "exact", "article", False)]
    assert 1 not in got and [tuple(r) for r in ready.request_errors(asked).collect()] == [(1, "query: 1 to 512 characters")]
    assert len(got[2]) == 1 and got[2][0]["total"] >= 2
    assert {r["bucket"] for r in got[3]} == {"alternatives"} and {r["external_id"] for r in got[4]} == {"p2"}
    assert {r["external_id"] for r in got[5]} == {"p3"}


def test_enrichment_fills_gaps_once_and_variants_cover(spark, tmp_path):
    answer = '{"normalized_title": "Hot plate", "synonyms": ["cooker"], "attributes": {"Color": "red", "power": "9"}, "use_cases": ["kitchen"], "spec_summary": "warm"}'
    config = Config(enrich=lambda card: F.when(card.contains("Plate"), F.lit(answer)).otherwise(F.lit("no json")), expand=lambda q: F.lit('{"stove": ["cooker"]}'))
    e = Engine.open(spark, str(tmp_path / "rich"), config)
    kinds = "external_id string, name string, attributes map<string,struct<t:string,s:string,n:double,b:boolean>>"
    e.upsert(spark.createDataFrame([("a", "Plate", {"power": ("n", None, 5.0, None)}), ("b", "Lamp", None)], kinds), ts("2024-01-01 00:00:00"))
    row = {r["external_id"]: r for r in e.store.read().collect()}
    assert row["a"]["attributes"]["power"]["n"] == 5.0 and row["a"]["attributes"]["color"]["s"] == "red" and row["a"]["enrichment"]["synonyms"] == ["cooker"] and row["b"]["enrichment"] is None
    e.config.enrich = lambda card: F.raise_error(F.lit("an unchanged row is not enriched again")).cast("string")
    e.upsert(spark.createDataFrame([("a", "Plate", {"power": ("n", None, 5.0, None)})], kinds), ts("2024-01-02 00:00:00"))
    assert e.store.read().where("external_id = 'a'").first()["enrichment"]["spec_summary"] == "warm"
    got = e.search(spark.createDataFrame([(0, "stove plate")], "query_id int, query string"), strict=True).collect()
    assert [(r["external_id"], r["bucket"], r["query_coverage"]) for r in got] == [("a", "items", 1.0)]


def test_jobs(engine, spark, tmp_path):
    jobs = sync.JobStore(spark, str(tmp_path / "jobs"))
    (tmp_path / "a.csv").write_text("id,name\nk1,one\nk2,\n", encoding="utf-8")
    done = jobs.get(engine.import_job(str(tmp_path / "a.csv"), ts("2024-01-02 00:00:00"), jobs))
    assert (done["status"], done["total"], done["processed"], done["failed"], done["errors"]) == ("completed", 2, 1, 1, ["row 2: name: missing"])
    assert jobs.get(engine.import_job("a.txt", ts("2024-01-02 00:00:00"), jobs))["detail"].startswith("Cannot parse file")
    open_ = jobs.create("later.csv")
    again = sync.JobStore(spark, str(tmp_path / "jobs"))
    assert again.get(open_)["status"] == "failed" and again.get(open_)["error"] == "interrupted by a service restart" and again.list().count() == 3


def test_labels_reports_and_judged_pool(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "lang": "en", "kind": "text", "relevant": {"x": 3, "y": 1}}\n\n{"query": "b", "lang": "uk", "kind": "code", "mode": "strict", "relevant": {"z": 2}}\n', encoding="utf-8")
    queries, qrels = evaluate.read_qrels(spark, str(tmp_path / "q.jsonl"))
    assert {(r["query"], r["mode"]) for r in queries.collect()} == {("a", "relaxed"), ("b", "strict")} and qrels.count() == 3
    hits = queries.select("query_id", F.explode(F.array(F.struct(F.lit("x").alias("doc_id"), F.lit(1).alias("rank")), F.struct(F.lit("w").alias("doc_id"), F.lit(2).alias("rank")))).alias("h")).select("query_id", "h.*")
    scores = evaluate.per_query(hits, qrels).join(queries, "query_id")
    evaluate.write_report(evaluate.segments(scores), scores, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "segments")).count() == 7
    assert evaluate.scorecard(evaluate.segments(scores)).split("\n")[1].startswith("overall")
    texts = spark.createDataFrame([("x", "tx"), ("w", "tw")], "doc_id string, text string")
    pool = evaluate.judge_pool(hits, qrels, lambda q, t: F.when(q == "a", 2).otherwise(1), texts, queries)
    assert {(r["doc_id"], r["grade"], r["missed"]) for r in pool.collect()} == {("w", 2, True), ("w", 1, False), ("x", 1, False)}


def test_filters_of_requests_are_those_of_calls(spark):
    from quarry.operators import filters

    v = lambda t, s=None, n=None, b=None: (t, s, n, b)
    products = spark.createDataFrame(
        [(1, "active", "bosch", "c", 5.0, True, {"k": v("n", n=1.0)}), (2, None, "acme", "d", None, False, {"k": v("b", b=True)}), (3, "archived", None, None, 9.0, None, None), (4, "active", "bosch", "d", 7.0, True, {"k": v("s", "1")})],
        "id int, status string, brand_norm string, category string, price double, in_stock boolean, attributes map<string,struct<t:string,s:string,n:double,b:boolean>>",
    )
    for f in (Filters(), Filters(brand="Bosch"), Filters(brand=""), Filters(price_min=6), Filters(price_max=6.0), Filters(in_stock=False), Filters(attributes={"k": 1}), Filters(attributes={"k": True}), Filters(attributes={"k": "1"}), Filters(include_archived=True, category="d")):
        want = {r[0] for r in products.where(filters.condition(f)).select("id").collect()}
        cols = filters.as_columns(f)
        got = {r[0] for r in products.where(filters.matches(F.struct(*[c.alias(k) for k, c in cols.items()]), F.struct(*filters.PRODUCT))).select("id").collect()}
        assert got == want, f


def test_a_second_writer_is_refused(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path / "s"), {"schema": "1"})
    df = spark.range(3).selectExpr("cast(id as string) external_id")
    for _ in range(8):
        store.write(df)
    assert len(store._names()) == store.KEPT and store.read().count() == 3
    behind = sync.Store(spark, str(tmp_path / "s"), {"schema": "1"})
    behind.version = lambda: store._names()[-2]
    with pytest.raises(sync.ConcurrentWrite):
        behind.write(df)


def test_metrics(spark):
    hit = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2)], "query_id int, doc_id string, grade int")
    got = {r[0]: tuple(r)[1:] for r in evaluate.per_query(hit, rel).collect()}
    assert got[1][0] == 1.0 and got[1][1] == 0.5 and abs(got[1][2] - 0.710) < 1e-3 and got[2] == (0.0, 0.0, 0.0)
    assert evaluate.bootstrap_interval([0.5]) == (0.5, 0.5)
    low, high = evaluate.bootstrap_interval([0.0, 1.0, 1.0, 0.5])
    assert low < 0.625 < high


def test_fuzzy_against_every_pair(spark):
    import random

    from quarry.functions.similarity import jaro_winkler, osa_similarity

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("AB12") for _ in range(n))
    stored = sorted({word(rng.randint(4, 9)) for _ in range(120)})
    asked = sorted({word(rng.randint(4, 9)) for _ in range(25)})
    c = spark.createDataFrame([(f"p{i}", "article", 0, w) for i, w in enumerate(stored)], "external_id string, field string, pos int, norm string")
    t = spark.createDataFrame([(i, 0, w) for i, w in enumerate(asked)], "query_id int, token_pos int, token_norm string")
    got = {(r["token_norm"], r["norm"]): r["score"] for r in codes.fuzzy(t, c).collect()}
    want = {}
    for a in asked:
        near = sorted(((round(osa_similarity(a, b), 9), b) for b in stored if osa_similarity(a, b) >= 0.72 - 1e-12), key=lambda x: (-x[0], x[1]))[:20]
        for _, b in near:
            s = 0.6 * osa_similarity(a, b) + 0.4 * jaro_winkler(a, b) - min(0.02 * abs(len(a) - len(b)), 0.1)
            if s >= 0.8:
                want[(a, b)] = round(min(s, 0.949), 4)
    assert got == want
