import pytest
from pyspark.sql import functions as F

from loomgrid.operators import models
from loomgrid.sources import genbank, readers, sinks

GBK = """LOCUS       X 60 bp DNA
FEATURES             Location/Qualifiers
     source          1..60
     CDS             1..9
                     /gene="abcA"
                     /locus_tag="T_1"
                     /product="first
                     protein"
                     /translation="MKV"
     CDS             complement(10..18)
                     /locus_tag="T_2"
                     /product="x [gene%3DdefB] y"
     CDS             19..24
                     /gene="BSUone"
                     /locus_tag="T_3"
                     /translation="MK"
ORIGIN
        1 atgaaagtgt tatttcataa aatgaaa
//
"""


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def folder(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        return str(path)

    return write


def test_similarity_edges(spark, folder):
    path = folder("e.tsv", "/a/x.1.fasta\t/b/y.fna\t99.5\t10\t12\nx.fasta\ty\t98\n")
    got = readers.similarity_edges(spark, path)
    assert [(r.query, r.reference, r.ani) for r in got.orderBy("ani").collect()] == [("x", "y", 98.0), ("x.1", "y.fna", 99.5)]
    assert got.where("coverage IS NULL").count() == 1
    assert {r.reference for r in readers.similarity_edges(spark, path, any_extension=True).collect()} == {"y"}


def test_blast_and_fasta(spark, folder):
    assert readers.blast(spark, folder("h.tsv", "q\ts\t99.0\t10\t1\t10\t5\t14\t1e-5\t50\n")).first().evalue == 1e-5
    got = readers.fasta(spark, folder("a.fa", ">s1 100-200\nACG\nTT\n>s2 5-9\n\nGG\n"))
    assert rows(got.select("id", "sequence", "length")) == [("s1", "ACGTT", 5), ("s2", "GG", 2)]
    assert rows(readers.region_fasta(spark, folder("r/strain.fa", ">k 100-200\nAC\n>k 5-9\nGG\n")).select("id")) == [("strain__region1__5-9",), ("strain__region2__100-200",)]
    with pytest.raises(Exception, match="no coordinates"):
        readers.region_fasta(spark, folder("bad/s.fa", ">nothing\nAC\n")).collect()
    assert {r.unit for r in readers.target_fasta(spark, folder("t/votu7.fa", ">x\nA\n")).collect()} == {"votu7"}


def test_region_summary_and_factor_hits(spark, folder):
    path = folder("s.txt", "head line\n 1  25.3Kb  intact(120)  foo  1234-5678  PHAGE_Bacill_SPP1(3)\nbad 2\n2 9Kb questionable(80) x 99-100 PHAGE_a\n")
    assert [(r.region, r.completeness, r.score, r.start, r.end, r.top_hit) for r in readers.region_summary(spark, path).collect()] == [(1, "intact", 120, 1234, 5678, "PHAGE_Bacill_SPP1")]
    assert rows(readers.factor_hits(spark, folder("st.1.txt", "# c\n\nLacI x\nLacI y\nTetR z\n"))) == [("st", "LacI"), ("st", "TetR")]


def test_delimited_documents_and_one_file(spark, folder):
    path = folder("k.csv", "a;b\n x ;y\n;z\n")
    assert rows(readers.delimited(spark, path, ["a", "b"])) == [("x", "y")]
    with pytest.raises(ValueError):
        readers.delimited(spark, path, ["a", "missing"])
    with pytest.raises(ValueError):
        readers.one_file(spark, path + ".none*")
    assert readers.one_file(spark, path).endswith("k.csv")
    table = readers.accumulation_table(spark, folder("n.Rtab", "10\t12\n11\t13\n"))
    assert rows(table.groupBy("n_genomes").avg("value")) == [(1, 10.5), (2, 12.5)]


def test_models_from_xml_and_json(spark, folder):
    xml = folder("m.xml", '<model><reaction id="R1" gene_rule="a and b"/><reaction id="R2"/></model>')
    got = models.with_alternatives(readers.sbml_reactions(spark, xml))
    assert {r.reaction: r.alternatives for r in got.collect()} == {"R1": [["a", "b"]], "R2": None}
    genes = spark.createDataFrame([("s", ["a"]), ("t", ["a", "b"])], "strain string, genes array<string>")
    assert rows(models.drafts(got, genes)) == [("s", "R2"), ("t", "R1"), ("t", "R2")]
    assert rows(models.drafts(got, genes, ["b"])) == [("s", "R1"), ("s", "R2"), ("t", "R1"), ("t", "R2")]
    path = folder("j/st.json", '{"reactions": [{"id": "R1", "gene_reaction_rule": "a"}, {"id": "R2"}]}')
    assert rows(readers.model_reactions(spark, path).select("strain", "reaction")) == [("st", "R1"), ("st", "R2")]


def test_genbank(spark, folder):
    path = folder("PS_edit2.gbk", GBK)
    plain = genbank.read(spark, path).collect()
    assert [(r.strain, r.gene, r.locus_tag, r.product, r.start, r.end, r.strand) for r in plain][0] == ("PS", "abcA", "T_1", "first protein", 1, 9, 1)
    assert [r.locus_tag for r in plain] == ["T_1", "T_3"]
    more = {r.locus_tag: (r.gene, r.strand, r.translation) for r in genbank.read(spark, path, translate="true", decode="true").collect()}
    assert more["T_2"] == ("defB", -1, "MK") and more["T_3"][0] is None
    tags = spark.createDataFrame([("T1",), ("none",)], "tag string")
    assert [(r.tag, r.locus_tag) for r in readers.by_alias(tags, genbank.read(spark, path)).collect()] == [("T1", "T_1")]
    assert [r["name"] for r in sinks.fasta_names(genbank.read(spark, path)).orderBy("start").collect()] == ["T_1", "T_3"]


def test_sheets_round_trip(spark, tmp_path, folder):
    df = spark.createDataFrame([("a", 1)], "x string, n int")
    sinks.write_sheets({"one": df, "empty": df.where("false")}, str(tmp_path / "book"))
    assert spark.read.parquet(str(tmp_path / "book/empty")).schema == df.schema
    folder("csv/genes.csv", "x\n1\n")
    folder("csv/notes.csv", "x\n2\n")
    assert rows(readers.sheets(spark, str(tmp_path / "csv"), exclude=("notes",)).select("x", "sheet")) == [("1", "genes")]
    sinks.write_mapping(df, str(tmp_path / "map"), "x")
    sinks.write_documents(df.selectExpr("x base_gene", "n"), str(tmp_path / "json"))
    assert readers.result_documents(spark, str(tmp_path / "json"), "base_gene string, n int").first().n == 1
    assert rows(sinks.report_rows("s", df.selectExpr("n a", "n + 1 b"))) == [("s", "a", "1"), ("s", "b", "2")]


def test_file_index_prefers_the_plain_name(spark, folder, tmp_path):
    for name in ("d/A_edit.gbk", "d/A.gbk", "d/B_edited.gbk"):
        folder(name, "x")
    got = {r.stem: r.path.rsplit("/", 1)[1] for r in readers.file_index(spark, str(tmp_path / "d")).collect()}
    assert got == {"A": "A.gbk", "B": "B_edited.gbk"}


def test_side_by_side(spark):
    df = spark.createDataFrame([("a", "f", "b", "g"), (None, None, "c", "h")], "c0 string, c1 string, c8 string, c9 string")
    assert rows(readers.side_by_side(df, ["c0", "c1"], ["c8", "c9"], ["gene", "role"])) == [("a", "f", "present"), ("b", "g", "absent"), ("c", "h", "absent")]


def test_locus_tags_under_all_spellings(spark):
    schema = "strain string, locus_tag string, product string, start int, end int"
    f = spark.createDataFrame([("s", "CUSTOM_01", "p", 5, 6), ("s", "Z", "x [locus_tag=BSU02] y", 1, 2), ("s", "Y", "[locus_tag=03]", 7, 8), ("s", "BS_U_04", None, 9, 10), ("s", "late", "[locus_tag=BSU_01]", 50, 51), ("t", "BSU_01", None, 3, 4)], schema)
    tags = spark.createDataFrame([("BSU_01",), ("BSU_02",), ("BSU_03",), ("BSU_04",), ("BSU_09",)], "tag string")
    assert rows(readers.by_alias(tags, f).select("tag", "strain", "locus_tag")) == [("BSU_01", "s", "CUSTOM_01"), ("BSU_01", "t", "BSU_01"), ("BSU_02", "s", "Z"), ("BSU_03", "s", "Y"), ("BSU_04", "s", "BS_U_04")]


def test_workbook_round_trip(spark, tmp_path):
    import zipfile

    from loomgrid.sources import workbook

    one = spark.createDataFrame([("a & <b>", 1, 2.5, True), (None, None, None, None), ("  x ", -3, 1e20, False)], "Feature_Name string, n int, v double, yes boolean")
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook({"first one": one.orderBy(F.col("n").asc_nulls_last()), "empty": one.where("false"), "notes": one.limit(0)}, path)
    assert rows(workbook.sheet_table(spark, path, "first one")) == [("  x ", "-3", "1e+20", "0"), ("a & <b>", "1", "2.5", "1")]
    assert workbook.sheet_table(spark, path, "empty").columns == one.columns and workbook.sheet_table(spark, path, "empty").count() == 0
    assert {r.sheet for r in workbook.read_cells(spark, str(tmp_path), exclude=("notes",)).collect()} == {"first one", "empty"}
    with pytest.raises(ValueError):
        workbook.sheet_table(spark, path, "missing")
    head, main = '<?xml version="1.0"?>', "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:  # shared strings, cell references, absolute parts, two blocks side by side
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="g1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>gene</t></si><si><r><t>ab</t></r><r><t>c</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="I1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>7.0</v></c><c r="I3" t="str"><v>z</v></c></row></sheetData></worksheet>')
    cells = workbook.positional(workbook.read_cells(spark, str(tmp_path / "other.xlsx")), 10)
    assert rows(readers.side_by_side(cells.where("row > 1"), ["c0", "c1"], ["c8", "c9"], ["gene", "role"])) == [("abc", "7", "present"), ("z", None, "absent")]


def test_fasta_csv_and_broken_documents(spark, tmp_path, folder):
    df = spark.createDataFrame([("s", "ACG")], "n string, q string")
    sinks.write_fasta(df, str(tmp_path / "fa"), "n", "q")
    assert rows(readers.fasta(spark, str(tmp_path / "fa")).select("id", "sequence")) == [("s", "ACG")]
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True)) == [("s", "ACG")]
    folder("docs/a.json", '{"base_gene": "x", "n": 1}')
    folder("docs/b.json", '{"base_gene": ')
    assert rows(readers.broken_documents(spark, str(tmp_path / "docs"), "base_gene string, n int")) == [("b.json",)]
    assert rows(readers.last_by_key(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string"), ["k"], "o").select("k", "v")) == [("k", "b")]


def test_models_are_kept_and_loaded(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from loomgrid.operators import learn

    df = spark.createDataFrame([([float(i % 2), 1.0], float(i % 2)) for i in range(20)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    learn.save(learn.fit_pipeline(df, "gaussian_nb"), str(tmp_path / "model"))
    assert learn.load(str(tmp_path / "model")).transform(df).where("prediction = label").count() == 20


def test_workbook_with_fills_and_odd_characters(spark, tmp_path):
    from loomgrid.sources import workbook

    path = str(tmp_path / "styled.xlsx")
    odd = ["\x01 bell\x07", "line\r\nend", "_x0001_ as text", "a\tb", "\U0001f600 <&>", None]
    df = spark.createDataFrame([(i, odd[i % 6], i % 4 == 0) for i in range(5000)], "n long, text string, ok boolean").orderBy("n").repartitionByRange(6, "n").sortWithinPartitions("n")
    styles = workbook.Styles({"n": "FFC000", "text": "C6EFCE"}, [("text", F.col("n") % 3 == 0, "FF0000"), ("text", F.col("ok"), "00FF00"), ("ok", F.col("text").isNull(), "0000FF")])
    workbook.write_workbook({"one": df, "plain": df.limit(2), "none": df.where("false")}, path, {"one": styles})
    cells = {r.row: r.cells for r in workbook.read_cells(spark, path, "one").collect()}
    assert len(cells) == 5001 and all(cells[i + 2] == [str(i), odd[i % 6], str(int(i % 4 == 0))] for i in range(5000))
    fills = {r.row: r.cells for r in workbook.read_cells(spark, path, "one", fills=True).collect()}
    assert fills[1] == ["FFC000", "C6EFCE", None]
    assert all(fills[i + 2] == [None, "FF0000" if i % 3 == 0 else "00FF00" if i % 4 == 0 else None, "0000FF" if i % 6 == 5 else None] for i in range(5000))
    assert {tuple(r.cells) for r in workbook.read_cells(spark, path, "plain", fills=True).collect()} == {(None, None, None)}
    assert workbook.read_cells(spark, path, "none").count() == 1
