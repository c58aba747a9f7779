"""Readers on small files of the documented shapes."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import members
from tallyspark.sources import arrays, house, press, reference_data, senate, sinks
from tallyspark.streaming import amendments


def test_press_lines(spark, tmp_path):
    row = {"url": "u", "title": "t", "date": "2026-02-03", "member": {"name": "A", "party": "D"}, "text": "H.R. 5"}
    (tmp_path / "2026-01.jsonl").write_text(json.dumps(row) + "\n\n" + "{bad\n" + json.dumps(row | {"date": "2026-05-01"}) + "\n")
    (tmp_path / "2025-12.jsonl").write_text(json.dumps(row) + "\n")
    paths = sorted(str(p) for p in tmp_path.iterdir())
    rows = press.read_press(spark, paths, years=[2026]).orderBy("pr_id").collect()
    assert [(r.src_file, r.src_line, r.quarter) for r in rows] == [("2026-01.jsonl", 1, "first_quarter"), ("2026-01.jsonl", 3, None), ("2026-01.jsonl", 4, "second_quarter")]
    assert rows[1].bad_line == "{bad" and rows[0].member.name == "A"
    assert sinks.raw_record(spark, paths[1], 3) == "{bad"
    assert press.read_press(spark, paths, years=[1999]).count() == 0


def test_senate_children(spark, tmp_path):
    people = [{"lobbyist": {"id": 1, "first_name": "Ann", "last_name": "B"}, "covered_position": None, "new": True}]
    first = {"filing_uuid": "f1", "filing_type": "Q1", "filing_year": 2026, "filing_period": "first_quarter", "income": "1,000.00", "expenses": None, "dt_posted": "2026-01-01T15:01:39-05:00", "registrant": {"id": 7, "name": "R"}, "client": {"id": 8, "client_id": 9, "name": "C"}, "lobbying_activities": [{"general_issue_code": "TAX", "description": "H.R. 1 and S. 2", "lobbyists": people, "government_entities": [{"id": 3, "name": "SENATE"}]}], "foreign_entities": [{"name": "F", "country": "X"}]}
    second = first | {"filing_uuid": "f2", "income": "bad", "lobbying_activities": [], "foreign_entities": []}
    (tmp_path / "filings_2026.json").write_text(json.dumps([first, second]))
    out = senate.read_filings(spark, str(tmp_path / "filings_2026.json"))
    rows = out["filings"].orderBy("src_index").collect()
    assert [(r.filing_uuid, r.src_index, r.income, r.client_id) for r in rows] == [("f1", 0, 1000.0, "8"), ("f2", 1, None, "8")]
    assert [r.bill for r in out["bill_mentions"].orderBy("mention_index").collect()] == ["HR1", "S2"]
    assert [out[k].count() for k in ("activities", "lobbyists", "gov_entities", "foreign_entities")] == [1, 1, 1, 1]
    report = {"filing_uuid": "c1", "filing_year": 2026, "filing_period": "mid_year", "filer_type": "lobbyist", "registrant": {"id": 1, "name": "R"}, "lobbyist": {"id": 2, "first_name": "Al", "last_name": "Ly"}, "pacs": ["P1 ", "P2"], "contribution_items": [{"contribution_type": "feca", "payee_name": "Pay, ", "honoree_name": "", "amount": "5.00", "date": "2026-01-01"}], "no_contributions": False}
    (tmp_path / "c.json").write_text(json.dumps([report]))
    out = senate.read_contributions(spark, str(tmp_path / "c.json"))
    assert out["reports"].select("lobbyist_name", "pacs").first() == ("Al Ly", "P1; P2")
    assert out["items"].select(senate.recipient().alias("r"), "amount").first() == ("PAY", 5.0)


def _as_pretty(rows):
    return json.dumps(rows, indent=2)


def _as_one_line(rows):
    return json.dumps(rows)


def _as_lines(rows):
    return "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n"


@pytest.mark.parametrize("write", [_as_pretty, _as_one_line, _as_lines])
@pytest.mark.parametrize("width", [997, 1 << 20])
def test_arrays_in_many_splits(spark, tmp_path, write, width):
    """Splits that fall anywhere: in strings full of braces, quotes and backslashes, and in elements longer than a split."""
    odd = ['}', '{', '"', "\\", '\\"}', '},{', "\\\\", "é}", "]", "", '[{"k": "}"}]']
    rows = [{"k": i, "s": odd[i % len(odd)] * (i % 7), "inner": [{"t": odd[(i * 3) % len(odd)]}] * (i % 3)} for i in range(300)]
    rows[150]["s"] = '}"{\\' * 700
    (tmp_path / "a.json").write_text(write(rows))
    (tmp_path / "b.json").write_text(write(rows[:1]))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps(rows[3]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(width))
        out = arrays.read_elements(spark, [str(tmp_path / f"{x}.json") for x in "abcd"], "k long, s string, inner array<struct<t string>>").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r.src_file, r.src_index, r.k, r.s, [x.t for x in r.inner]) for r in out)
    want = [("a.json", i, x["k"], x["s"], [y["t"] for y in x["inner"]]) for i, x in enumerate(rows)]
    assert got == [*want, ("b.json", *want[0][1:]), ("d.json", 0, *want[3][2:])]


def test_array_files_are_read_in_parallel(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"filing_uuid": f"f{i}", "filing_type": "}" * 40} for i in range(2000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        out = senate.read_filings(spark, str(tmp_path / "f.json"))["filings"]
        assert out.rdd.getNumPartitions() > 1 and sorted((r.src_index, r.filing_uuid) for r in out.collect()) == [(i, f"f{i}") for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_in_order_from_many_tasks(spark, tmp_path):
    df = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("k")).withColumn("value", F.concat(F.lit("n"), "k"))
    sinks.save_lines(df, str(tmp_path / "x.txt"), by=["k"])
    assert (tmp_path / "x.txt").read_text().split() == [f"n{k}" for k in range(5000)]


def test_press_lines_in_many_splits(spark, tmp_path):
    """No task reads a whole file; lines and rows keep their numbers over blank lines, bad ones and files of other sizes."""
    want, n = [], 0
    for name, lines in (("2025-01.jsonl", 400), ("2025-02.jsonl", 1), ("2025-03.jsonl", 90)):
        text = []
        for k in range(lines):
            blank = k % 5 == 3 or 100 < k < 160
            text.append(" " if blank else "{bad" if k % 17 == 0 else json.dumps({"url": f"{name}{k}", "text": "x" * (k % 40)}))
            if not blank:
                n += 1
                want.append((n, name, k + 1, None if k % 17 == 0 else f"{name}{k}"))
        (tmp_path / name).write_text("\r\n".join(text))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "700")
        out = press.read_press(spark, [str(p) for p in tmp_path.glob("*.jsonl")])
        assert out.select(F.spark_partition_id()).distinct().count() > 3
        assert sorted((r.pr_id, r.src_file, r.src_line, r.url) for r in out.collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


DOC = """<LOBBYINGDISCLOSURE2><organizationName>Org</organizationName><clientName> Cl </clientName><senateID>1-2</senateID><houseID>3</houseID><income>10</income><expenses> </expenses>%s</LOBBYINGDISCLOSURE2>"""
BLOCK = "<alis><ali_info><issueAreaCode>TAX</issueAreaCode><specific_issues><description>d</description></specific_issues><federal_agencies>A,B</federal_agencies><lobbyists><lobbyist><lobbyistFirstName>X</lobbyistFirstName><lobbyistLastName>Y</lobbyistLastName></lobbyist><lobbyist><lobbyistFirstName> </lobbyistFirstName><lobbyistLastName> </lobbyistLastName></lobbyist></lobbyists></ali_info></alis>"


def test_house_blocks(spark, tmp_path):
    folder = tmp_path / "2026_1stQuarter_XML"
    folder.mkdir()
    (folder / "1.xml").write_text(DOC % BLOCK)
    (folder / "2.xml").write_text(DOC % "<ali_Code>BUD</ali_Code><specific_issues><description>e</description></specific_issues><lobbyists><lobbyist><lobbyistFirstName>P</lobbyistFirstName><lobbyistLastName>Q</lobbyistLastName></lobbyist></lobbyists>")
    out = house.read_house(spark, str(folder))
    assert [(r.filing_id, r.filing_year, r.filing_period, r.client_name, r.income, r.expenses) for r in out["filings"].orderBy("filing_id").collect()] == [("1", 2026, "first_quarter", "Cl", 10.0, None), ("2", 2026, "first_quarter", "Cl", 10.0, None)]
    assert sorted((r.filing_id, r.ali_index, r.code) for r in out["alis"].collect()) == [("1", 0, "TAX"), ("2", None, "BUD")]
    assert sorted((r.filing_id, r.last_name) for r in out["lobbyists"].collect()) == [("1", "Y"), ("2", "Q")]
    assert house.folder_period("x/2025_Registrations_XML") == (2025, "RR") and house.folder_period("x/other") is None


def test_reference_files(spark, tmp_path):
    (tmp_path / "roster.txt").write_text("# c\nAcme #1\n\n Acme #1\n  # d\nBeta\n")
    assert sorted(r.name for r in reference_data.read_roster(spark, str(tmp_path / "roster.txt")).collect()) == ["Acme #1", "Beta"]
    person = {"id": {"bioguide": "S1", "fec": ["H1", "S2"]}, "name": {"first": "Kyr", "last": "Sin", "official_full": "Kyr Sin"}, "terms": [{"type": "sen", "start": "2019-01-03", "end": "2025-01-03", "state": "AZ", "party": "Independent", "party_affiliations": [{"start": "2019-01-03", "end": "2022-12-09", "party": "Democrat"}, {"start": "2022-12-09", "end": "2025-01-03", "party": "Independent"}]}]}
    (tmp_path / "m.json").write_text(json.dumps([person]))
    people, terms = reference_data.read_legislators(spark, [str(tmp_path / "m.json")])
    assert people.first().party == "I" and terms.count() == 2
    gifts = spark.createDataFrame([(1, "S1", date(2022, 6, 1)), (2, "S1", date(2023, 6, 1)), (3, "S1", date(2026, 1, 1)), (4, "S1", None)], "gift_id int, bioguide_id string, day date")
    assert [(r.party, r.source) for r in members.party_at(gifts, terms).orderBy("gift_id").collect()] == [("D", "term-dated"), ("I", "term-dated"), ("I", "nearest-term"), ("I", "latest-term")]
    line = "|".join(["C1", "OLD", *["x"] * 6, "D", "O", "DEM", "", "", "", "H1"])
    (tmp_path / "cm22.txt").write_bytes((line + "\nshort|row\n").encode("latin-1"))
    (tmp_path / "cm24.txt").write_bytes(line.replace("OLD", "NÉW").encode("latin-1"))
    assert reference_data.read_committees(spark, {2022: str(tmp_path / "cm22.txt"), 2024: str(tmp_path / "cm24.txt")}).select("cmte_name", "cycles").collect() == [("NÉW", "2022;2024")]


MEMBERS = [
    {"bioguide_id": "E1", "name": "Thomas Emmer", "first": "Thomas", "last": "Emmer", "nickname": "Tom", "chamber": "House"},
    {"bioguide_id": "M1", "name": "Robert Menendez", "first": "Robert", "last": "Menendez", "nickname": None, "chamber": "Senate"},
    {"bioguide_id": "M2", "name": "Robert Menendez", "first": "Robert", "last": "Menendez", "nickname": None, "chamber": "House"},
    {"bioguide_id": "V1", "name": "Chris Van Hollen", "first": "Chris", "last": "Van Hollen", "nickname": None, "chamber": "Senate"},
]
COMMITTEES = [{"cmte_id": "C1", "cmte_name": "Emmer for Congress", "bioguide_id": "E1", "tier": "campaign", "confidence": "id"}, {"cmte_id": "C2", "cmte_name": "Joint Victory Fund", "bioguide_id": "E1", "tier": "jfc", "confidence": "name"}]


MORE = [
    {"bioguide_id": "O1", "name": "Beto O'Rourke", "first": "Robert", "last": "O'Rourke", "nickname": "Beto", "chamber": "House"},
    {"bioguide_id": "B1", "name": "Nikki Budzinski", "first": "Nicole (Nikki)", "last": "Budzinski", "nickname": None, "chamber": "House"},
    {"bioguide_id": "K1", "name": "Mary Jo Kilroy", "first": "Mary Jo", "last": "Kilroy", "nickname": None, "chamber": "House"},
    {"bioguide_id": "R1", "name": "Lisa Blunt Rochester", "first": "Lisa", "last": "Blunt Rochester", "nickname": None, "chamber": "Senate"},
]


def test_members(spark):
    people = spark.createDataFrame(MEMBERS + MORE, "bioguide_id string, name string, first string, last string, nickname string, chamber string")
    committees = spark.createDataFrame([*COMMITTEES, {"cmte_id": "C3", "cmte_name": "ABC PAC", "bioguide_id": "V1", "tier": "leadership-pac", "confidence": "linked"}], "cmte_id string, cmte_name string, bioguide_id string, tier string, confidence string")
    tables = (
        people, committees, spark.createDataFrame([("BOB", "ROBERT")], "a string, b string"), spark.createDataFrame([("R1", "LISA ROCHESTER")], "bioguide_id string, spelling string"),
        spark.createDataFrame([("Emmer Cttee", "C1")], "spelling string, cmte_id string"), spark.createDataFrame([("NRCC", "NRCC")], "key string, display string"),
    )
    cases = {
        "Rep. Tom Emmer": ("member", "E1", "direct", "matched"), "EMMER, TOM": ("member", "E1", "direct", "inverted"), "T. Emmer Jr.": ("member", "E1", "direct", "matched"), "Sen. Bob Menendez": ("member", "M1", "direct", "title-chamber"),
        "Emmer for Congress": ("committee", "E1", "campaign", "id"), "Emmer for Congress Inc Campaign": ("committee", "E1", "campaign", "prefix"), "Joint Victory Fund": ("committee", "E1", "jfc-shared, unallocated", "name"), "ABC PAC Leadership": ("committee", "V1", "leadership-pac", "prefix"),
        "EMMER CTTEE": ("committee", "E1", "campaign", "id"), "NRCC": ("party-committee", None, None, "NRCC"), "N/A": ("unresolved", None, None, None), None: ("unresolved", None, None, None), "Emmer": ("unresolved", None, None, None), "Senator Chris Van Hollen": ("member", "V1", "direct", "matched"),
        "Beto O'Rourke": ("member", "O1", "direct", "matched"), "Bob O'Rourke": ("member", "O1", "direct", "matched"), "Nicole Budzinski": ("member", "B1", "direct", "matched"), "Nikki Budzinski": ("member", "B1", "direct", "matched"), "Mary Kilroy": ("member", "K1", "direct", "matched"),
        "Lisa Rochester": ("member", "R1", "direct", "alias"), "The Hon. Tessa Emmer": ("member", "E1", "direct", "title-initial"), "Tessa Emmer": ("unresolved", None, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases] * 2, "raw string")
    found = {x.query: (x.kind, x.bioguide_id, x.tier, x.confidence) for x in members.resolve_recipients(df, "raw", *tables).collect()}
    assert found == cases
    several = ["Robert Menendez", "Tom Emmer; Chris Van Hollen; NRCC", "Sen. Chris Van Hollen, Rep. Tom Emmer, Nobody"]
    rows = members.resolve_recipients(spark.createDataFrame([(x,) for x in several], "raw string"), "raw", *tables).collect()
    of = lambda q: sorted((x.kind, x.bioguide_id or "", x.confidence, x.ambiguous) for x in rows if x.query == q)
    assert of(several[0]) == [("member", "M1", "ambiguous", True), ("member", "M2", "ambiguous", True)]
    assert of(several[1]) == [("compound", "", "compound:NRCC", False), ("compound", "E1", "compound:matched", False), ("compound", "V1", "compound:matched", False)]
    assert of(several[2]) == [("compound", "E1", "compound:matched", False), ("compound", "V1", "compound:matched", False)]


def test_crosswalk_sources(spark):
    people = spark.createDataFrame([("L1", "Cynthia Lummis", "Cynthia", "Lummis", None, "WY", "S1"), ("E1", "Tom Emmer", "Thomas", "Emmer", "Tom", "MN", "H1;H2"), ("S1", "Al Smith", "Al", "Smith", None, "WA", None), ("S2", "Bo Smith", "Bo", "Smith", None, "OR", None)], "bioguide_id string, name string, first string, last string, nickname string, state string, fec_ids string")
    cm = spark.createDataFrame([("C1", "EMMER FOR CONGRESS", "P", "H2"), ("C2", "LUMMIS VICTORY COMMITTEE", "J", None), ("C3", "EMMERGENCE", "D", None), ("C4", "SMITH VICTORY", "J", None), ("C5", "BO SMITH VICTORY", "J", None), ("C6", "BIG", "D", None), ("C7", "X", "U", "H1")], "cmte_id string, cmte_name string, designation string, cand_id string")
    links = spark.createDataFrame([("H1", "C1", "P"), ("S1", "C1", "J")], "cand_id string, cmte_id string, designation string")
    sponsors = spark.createDataFrame([("C3", "H1"), ("C6", "P9"), ("C6", "P8")], "cmte_id string, cand_id string")
    candidates = spark.createDataFrame([("P9", "LUMMIS, CINDY M", "US"), ("P8", "SMITH, AL", "OR")], "cand_id string, name string, state string")
    nick = spark.createDataFrame([("CINDY", "CYNTHIA")], "a string, b string")
    out = members.committee_crosswalk(people, cm, links, sponsors, candidates, nick).collect()
    assert sorted((r.cmte_id, r.bioguide_id, r.tier, r.link_source, r.confidence) for r in out) == [
        ("C1", "E1", "campaign-committee", "fec-ccl", "linked"), ("C1", "L1", "jfc", "fec-ccl", "linked"), ("C2", "L1", "jfc", "name-inference", "inferred"),
        ("C3", "E1", "leadership-pac", "openfec-sponsor", "linked"), ("C5", "S2", "jfc", "name-inference", "inferred"), ("C6", "L1", "leadership-pac", "cn-name-inference", "inferred"),
    ]


def test_links_and_subsets(spark):
    a = spark.createDataFrame([("C1", "E1", "ccl")], "cmte_id string, bioguide_id string, link_source string")
    b = spark.createDataFrame([("C1", "E1", "cn"), ("C2", "E1", "cn")], "cmte_id string, bioguide_id string, link_source string")
    assert sorted(tuple(r) for r in members.committee_links([a, b]).collect()) == [("C1", "E1", "ccl"), ("C2", "E1", "cn")]
    names = spark.createDataFrame([("Coinbase Global",), ("Acme",), ("Other Co",), ("Big Bank of America",), ("ACME corp plus",)], "name string")
    roster = spark.createDataFrame([("COINBASE",), ("Coinbase Global Markets",), ("Acme",), ("Bank",), ("plus Acme",)], "player string")
    assert sorted(tuple(r) for r in members.token_subset_matches(names, roster).collect()) == [("ACME corp plus", "plus Acme", "candidate"), ("Acme", "Acme", "exact"), ("Coinbase Global", "Coinbase Global Markets", "candidate")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for _ in range(2):
        sinks.save({"t": df}, str(tmp_path / "db"), {"t": "k"})
    assert spark.read.parquet(str(tmp_path / "db/t")).count() == 2
    sinks.save_csv(df, str(tmp_path / "t.csv"), query="SELECT *\nFROM t")
    assert (tmp_path / "t.csv").read_bytes() == b"\xef\xbb\xbfk,v\n1,a\n2,\n" and (tmp_path / "t.csv.sql").read_text() == "SELECT *\nFROM t\n"
    with pytest.raises(Exception, match="another length"):
        sinks.save_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, v array<float>"), str(tmp_path / "v"), "v", 2)
    assert sorted(tuple(r) for r in sinks.sanity({"t": df, "u": df}, {"t": 2, "u": 3}).collect()) == [("t", 2, 2, False), ("u", 2, 3, True)]
    assert [r.value for r in sinks.as_json(df).collect()] == ['{"k":1,"v":"a"}', '{"k":2}']
    reference_data.write_roster(df, "v", str(tmp_path / "r"))
    assert [r.name for r in reference_data.read_roster(spark, str(tmp_path / "r")).collect()] == ["a"]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "registrant string, client string, posted string, filing_uuid string, amount double"
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, rows in enumerate([[("R", "C", "2025-01-01", "a", 1.0)], [("R", "C", "2025-02-01", "b", 2.0), ("R", "D", "2025-01-01", "c", 3.0)], [("R", "C", "2025-01-15", "d", 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        amendments.upsert_latest(spark.readStream.schema(schema).json(str(source)), target, str(tmp_path / "cp"), ["registrant", "client"]).awaitTermination()
        assert k >= 0
    assert sorted((r.client, r.filing_uuid) for r in amendments.current(spark, target).collect()) == [("C", "b"), ("D", "c")]
