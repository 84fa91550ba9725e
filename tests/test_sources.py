import itertools

from strandlake.sources import alignments as A
from strandlake.sources import tables as T

STO = """# STOCKHOLM 1.0
#=GF ID  fam1
#=GS s1 WT 0.5
s1   AC=G
s2   A..G
#=GC SS_cons <..>

s1   UU
s2   -U
#=GR s2 SS ((..
#=GC SS_cons ::
//
# STOCKHOLM 1.0
x/1-4 ACGU
//
"""


def test_stockholm(spark, tmp_path):
    (tmp_path / "a.sto").write_text(STO)
    s, c = A.read_stockholm(spark, str(tmp_path / "a.sto"))
    rows = {(r.sqname): r for r in s.collect()}
    assert rows["s1"].aseq == "AC.GUU" and rows["s1"].wgt == 0.5 and rows["s2"].aseq == "A..G-U" and rows["s2"].ss == "((.."
    assert rows["x/1-4"].aln_id.startswith("msa")
    assert {r.ss_cons for r in c.collect()} == {"<..>::", None}
    seqs = spark.createDataFrame([("A", 0, "a b", "AC-", None, None), ("A", 1, None, "GG.", None, None), ("B", 0, "z", "", None, None), ("B", 1, "z", "U", None, None)], A.SEQS)
    cols = spark.createDataFrame([("A", "<.>", None, None)], A.COLS)
    A.write_stockholm(seqs, cols, str(tmp_path / "out"))
    s, c = A.read_stockholm(spark, str(tmp_path / "out"))
    assert {(r.aln_id, r.sqname, r.aseq) for r in s.collect()} == {("A", "a_b.0", "AC-"), ("A", "seq.1", "GG."), ("B", "z.1", "U")}
    assert {(r.aln_id, r.ss_cons) for r in c.collect()} == {("A", "<.>"), ("B", None)}


def test_fasta(spark, tmp_path):
    d = spark.createDataFrame([("a", "ACGU" * 40), ("b", ""), ("c", None), ("d", "-A~")], "name string, seq string")
    A.write_fasta(d, str(tmp_path / "f"))
    got = {(r.name, r.seq) for r in A.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {("a", "ACGU" * 40), ("b", ""), ("d", "-A~")}
    (tmp_path / "g.fa").write_text(">x some words\nAC\nGU\n>y\nRYN\n")
    rows = {r.name: r for r in A.one_hot(A.read_fasta(spark, str(tmp_path / "g.fa"))).collect()}
    assert rows["x"].descr == "some words" and rows["x"].seq == "ACGU"
    assert rows["y"].profile == [[0.5, 0, 0.5, 0], [0, 0.5, 0, 0.5], [0.25] * 4]


def test_newick(spark, tmp_path):
    e = A.parse_newick("((a:1,b:2):0.5,'c d':3e-1);")
    assert [(p, n, b) for p, _, n, b in e] == [(0, None, 0.5), (1, "a", 1.0), (1, "b", 2.0), (0, "c d", 0.3)]
    (tmp_path / "t.nwk").write_text("(a,b);\n((x:1,y:1):1,z:2);")
    assert A.read_newick(spark, str(tmp_path / "t.nwk")).where("is_leaf").count() == 5


def test_tables(spark, tmp_path):
    (tmp_path / "p").write_text("# c\n0 -0.1\n5 0.2\n6 1.2\n7 0.3\n")
    assert [r.prob for r in T.read_power(spark, str(tmp_path / "p")).orderBy("subs").collect()] == [0, 0.2, 1, 1]
    (tmp_path / "h").write_text("0.5 3\n0.7 2\n1.1 1\n")
    assert all(abs(r.w - 0.2) < 1e-12 for r in T.read_null_histogram(spark, str(tmp_path / "h")).collect())
    (tmp_path / "m").write_text("JOINT\n0.1 0.2\n0.3 0.4\nBACK\nA 1\nC 2\n")
    assert {(r.name, r.a, r.b): r.v for r in T.read_matrices(spark, str(tmp_path / "m")).collect()} == {("JOINT", 0, 0): 0.1, ("JOINT", 0, 1): 0.2, ("JOINT", 1, 0): 0.3, ("JOINT", 1, 1): 0.4, ("BACK", 0, 0): 1.0, ("BACK", 1, 0): 2.0}
    (tmp_path / "r").write_text("muA 0.5 ldI 1e-2 | model AIF\n")
    assert {(r.model, r.name, r.v) for r in T.read_rates(spark, str(tmp_path / "r")).collect()} == {("AIF", "muA", 0.5), ("AIF", "ldI", 0.01)}
    (tmp_path / "g").write_text("# motifs\nHL GNRA - tetra # note\nIL AG CU - UU loop\nJ3 A C G three\n")
    m = T.read_motifs(spark, str(tmp_path / "g"))
    assert {(r.kind, r.name, tuple(r.segments)) for r in m.collect()} == {("HL", "tetra", ("GNRA", "")), ("IL", "loop", ("AG", "CU", "", "UU")), ("J3", "three", ("A", "C", "G"))}
    assert {tuple(r.segments) for r in T.rotations(m).where("kind = 'J3'").collect()} == {("A", "C", "G"), ("C", "G", "A"), ("G", "A", "C")}


def test_motif_scan(spark):
    d = spark.createDataFrame([(1, "GAAAGCAA"), (2, ""), (3, None)], "seq_id long, res string")
    got = sorted((r.motif, r.pos) for r in T.scan_segments(d, [("gnra", "GNRA"), ("aa", "AA")]).collect())
    s = "GAAAGCAA"
    assert got == sorted([("gnra", 1), ("gnra", 5), *(("aa", i + 1) for i in range(7) if s[i : i + 2] == "AA")])


def test_reports(spark, tmp_path):
    (tmp_path / "h.cov").write_text("# MSA fam_a nseq 5\n#left right\n*\t3\t20\t45.2\t0.001 x\n\t4\t19\t40\t1.5 x\n# MSA fam_b\n**\t1\t9\t8\t2e-3 y\n")
    got = [tuple(r) for r in T.read_hits(spark, str(tmp_path / "h.cov")).collect()]
    assert got == [("fam_a", "*", 3, 20, 45.2, 0.001), ("fam_a", "", 4, 19, 40.0, 1.5), ("fam_b", "**", 1, 9, 8.0, 0.002)]
    line = " ".join(map(str, ["t1", "-", 100, "q1", "-", 50, 1e-9, 30, 0, 1, 1, 1e-5, 1e-9, 29.5, 0.1, 2, 48, 10, 60, 9, 61, 0.9, "d"]))
    (tmp_path / "d.tbl").write_text("# head\n" + line + "\n")
    r = T.read_domains(spark, str(tmp_path / "d.tbl")).first()
    assert (r.target, r.query, r.evalue, r.score, r.hmm_from, r.ali_to) == ("t1", "q1", 1e-9, 29.5, 2, 60)
    d = spark.createDataFrame([("a", 1.5), (None, 2.0)], "k string, v double")
    T.write_table(d, str(tmp_path / "w"), "v")
    assert [x.value for x in spark.read.text(str(tmp_path / "w")).collect()] == ["a\t1.5", "-\t2.0"]
    assert T.monotone([1, 1, 2]) and not T.monotone([2, 1]) and list(itertools.islice([], 1)) == []
