"""Proofs, names, numbering, skew and outcomes."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.operators import outcomes as out
from folioworks.operators import reconcile as rec
from folioworks.operators import references as ref
from folioworks.operators.naming import assign_names
from folioworks.operators.numbering import with_progress
from folioworks.operators.skew import spread_join

from fixtures import IMAGE

few = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
MANIFEST = "container string, part_name string, ordinal int, crc long, file_size long"


def manifest(spark, *rows):
    """Rows: (name, crc, size), in archive order."""
    return spark.createDataFrame(
        [("c", name, i, crc, size) for i, (name, crc, size) in enumerate(rows)], MANIFEST
    )


PARTS = [("word/document.xml", 1, 10), ("word/media/a.png", 2, 20), ("word/styles.xml", 3, 30)]


def messages(violations):
    return [r.message for r in violations.orderBy("rule_no", "ordinal").collect()]


@pytest.mark.parametrize(
    "after, expected",
    [
        (PARTS, []),
        ([PARTS[0], ("word/media/a.png", 9, 9), PARTS[2]], []),
        (PARTS[:2], [fv.BAD_MEMBERS]),
        ([*PARTS, ("x", 1, 1)], [fv.BAD_MEMBERS]),
        ([PARTS[0], PARTS[2]], [fv.BAD_MEMBERS, "nº de imagens difere: 1 vs 0"]),
        ([("word/document.xml", 7, 10), *PARTS[1:]], ["parte não-imagem alterada: word/document.xml"]),
        ([("word/document.xml", 1, 11), *PARTS[1:]], ["parte não-imagem alterada: word/document.xml"]),
    ],
)
def test_first_pass_manifest_rules(spark, after, expected):
    got = rec.manifest_violations(manifest(spark, *PARTS), manifest(spark, *after))
    assert messages(got) == expected


def test_first_pass_manifests_meet_in_one_pass(spark):
    """Members, media and changed parts together: two shuffles, one of them used twice."""
    before = manifest(spark, *PARTS)
    found = rec.manifest_violations(before, manifest(spark, *PARTS[:2]))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert len([x for x in plan.split("\n") if " Exchange hashpartitioning" in x]) <= 3


def test_totals_of_two_manifests(spark):
    rows = [(c, n, i, crc, 1) for c, names in {
        "a": [("word/media/1", 1), ("word/media/2", 1), ("x", 1), ("y", 1)], "gone": [("word/media/1", 1)], "none": [],
    }.items() for i, (n, crc) in enumerate(names)]
    after = [("a", "word/media/1", 0, 9, 9), ("a", "y", 3, 2, 1), ("a", "x", 5, 2, 1), ("new", "z", 0, 1, 1)]
    judged = rec._manifests(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(after, MANIFEST))
    got = {r.container: r for r in rec.manifest_totals(judged).collect()}
    a = got["a"]
    assert (a.members_differ, a.media_count, a.media_after, a.compared, a.changed_parts) == (True, 2, 1, True, 2)
    assert (a.first_changed.ordinal, a.first_changed.part_name) == (2, "x")
    assert {c: (r.members_differ, r.compared, r.changed_parts, r.first_changed) for c, r in got.items() if c != "a"} == {
        "gone": (True, False, 0, None), "new": (True, False, 0, None)}


def test_a_name_entered_twice_counts_as_its_last_entry(spark):
    before = manifest(spark, ("a", 1, 1), ("a", 2, 2))
    assert rec.reconcile(before, manifest(spark, ("a", 2, 2))).count() == 0
    assert rec.reconcile(before, manifest(spark, ("a", 1, 1))).count() == 1


RENAMES = [("c", "word/media/a.png", "word/media/a.jpeg")]
RENAME_SCHEMA = "container string, part_name string, new_part_name string"


@pytest.mark.parametrize(
    "after, expected",
    [
        ([PARTS[0], ("word/media/a.jpeg", 9, 9), PARTS[2]], []),
        (PARTS, ["lista de membros do ZIP inesperada. Faltando: ['word/media/a.jpeg'] "
                 "Sobrando: ['word/media/a.png']"]),
        ([("word/document.xml", 8, 8), ("word/media/a.jpeg", 9, 9), PARTS[2]],
         ["parte alterada indevidamente: word/document.xml"]),
        ([*PARTS[::2], ("word/media/a.jpeg", 9, 9), ("word/media/b.jpeg", 9, 9)],
         ["lista de membros do ZIP inesperada. Faltando: [] Sobrando: ['word/media/b.jpeg']",
          "nº de imagens em word/media difere: 1 vs 2"]),
    ],
)
def test_second_pass_manifest_rules(spark, after, expected):
    renames = spark.createDataFrame(RENAMES, RENAME_SCHEMA)
    got = rec.manifest_violations_renamed(manifest(spark, *PARTS), manifest(spark, *after), renames)
    assert messages(got) == expected


def test_rels_and_content_types_may_change_when_renaming(spark):
    rows = [("[Content_Types].xml", 1, 1), ("word/_rels/document.xml.rels", 1, 1)]
    changed = [(name, 2, 2) for name, _, _ in rows]
    renames = spark.createDataFrame([], RENAME_SCHEMA)
    assert rec.reconcile_renamed(manifest(spark, *rows), manifest(spark, *changed), renames).count() == 0
    assert rec.reconcile(manifest(spark, *rows), manifest(spark, *changed)).count() == 2


def test_five_names_are_shown(spark):
    before = manifest(spark, *[(f"n{i}", 1, 1) for i in (5, 3, 9, 1, 7, 2)])
    row = rec.member_diff(rec.reconcile(before, manifest(spark, ("z", 1, 1)))).first()
    assert row.missing == ["n1", "n2", "n3", "n5", "n7"] and row.extra == ["z"]


RELS = "container string, rels_path string, pos int, rel_id string, rel_type string, target string, target_mode string"
RELS_PATH = "word/_rels/document.xml.rels"
A, LINK = ("rId1", IMAGE, "media/a.png", None), ("rId2", "link", "https://x", "External")
GOOD = ("rId1", IMAGE, "media/a.jpeg", None)


def references(spark, *rows):
    return spark.createDataFrame([("c", RELS_PATH, i, *r) for i, r in enumerate(rows)], RELS)


@pytest.mark.parametrize(
    "after, expected",
    [
        ([GOOD, LINK], None),
        ([A, LINK], None),
        ([GOOD], fv.BAD_REL_IDS),
        ([GOOD, LINK, ("rId3", "t", "u", None)], fv.BAD_REL_IDS),
        ([("rId1", "other", "media/a.jpeg", None), LINK], "relacionamento rId1: Type/TargetMode alterado"),
        ([GOOD, ("rId2", "link", "https://x", None)], "relacionamento rId2: Type/TargetMode alterado"),
        ([GOOD, ("rId2", "link", "https://y", "External")],
         "relacionamento rId2: Target alterado em relacionamento não-imagem"),
        ([("rId1", IMAGE, "media/b.jpeg", None), LINK],
         "relacionamento rId1: novo Target inesperado (media/b.jpeg)"),
        ([("rId1", IMAGE, "/word/media/a.jpeg", None), LINK],
         "relacionamento rId1: novo Target inesperado (/word/media/a.jpeg)"),
    ],
)
def test_relationship_rules(spark, after, expected):
    renames = spark.createDataFrame(RENAMES, RENAME_SCHEMA)
    got = messages(rec.diff_relationships(references(spark, A, LINK), references(spark, *after), renames))
    assert got == ([] if expected is None else [f"{RELS_PATH}: {expected}"])


def test_image_target_changed_without_rename(spark):
    renames = spark.createDataFrame([], RENAME_SCHEMA)
    got = messages(rec.diff_relationships(references(spark, A), references(spark, GOOD), renames))
    assert got == [f"{RELS_PATH}: relacionamento rId1: Target alterado sem conversão correspondente"]


CT = "container string, kind string, key string, content_type string, pos int"
DECLARED = [("default", "png", "image/png"), ("override", "/word/document.xml", "main"),
            ("override", "/word/media/a.png", "image/png")]


def declarations(spark, *rows):
    return spark.createDataFrame([("c", *r, i) for i, r in enumerate(rows)], CT)


@pytest.mark.parametrize(
    "after, expected",
    [
        (DECLARED, None),
        ([*DECLARED[:2], ("default", "jpeg", "image/jpeg")], None),
        ([("default", "png", "other"), *DECLARED[1:]], None),
        (DECLARED[1:], "um Default existente foi removido"),
        ([*DECLARED, ("default", "bmp", "x")], "Default(s) inesperado(s) adicionado(s): {'bmp'}"),
        ([DECLARED[0], DECLARED[2]],
         "Override(s) removido(s) indevidamente: {'/word/document.xml'}"),
        ([*DECLARED, ("override", "/n", "x")], "Override(s) inesperado(s) adicionado(s)"),
        ([DECLARED[0], ("override", "/word/document.xml", "other"), DECLARED[2]],
         "ContentType de /word/document.xml alterado"),
    ],
)
def test_content_type_rules(spark, after, expected):
    renames = spark.createDataFrame(RENAMES, RENAME_SCHEMA)
    got = messages(
        rec.diff_content_types(declarations(spark, *DECLARED), declarations(spark, *after), renames)
    )
    assert got == ([] if expected is None else [f"[Content_Types].xml: {expected}"])


def test_content_types_follow_renames(spark):
    renames = spark.createDataFrame(RENAMES, RENAME_SCHEMA)
    ct = declarations(spark, *DECLARED)
    got = ref.rewrite_content_types(ct, renames, ref.jpeg_extension(ct))
    assert sorted((r.kind, r.key) for r in got.collect()) == [
        ("default", "jpeg"), ("default", "png"), ("override", "/word/document.xml"),
    ]
    none = spark.createDataFrame([], RENAME_SCHEMA)
    assert ref.rewrite_content_types(ct, none, ref.jpeg_extension(ct)).count() == 3


def test_references_follow_renames(spark):
    rows = [
        ("rId1", IMAGE, "media/a.png", None), ("rId2", IMAGE, "../word/media/a.png", None),
        ("rId3", IMAGE, "/word/media/a.png", None), ("rId4", IMAGE, "https://h/media/a.png", None),
        ("rId5", "link", "media/a.png", None), ("rId6", IMAGE, None, None), ("rId7", IMAGE, "", None),
        ("rId8", IMAGE, "media/A.png", None),
    ]
    got = ref.rewrite_references(
        references(spark, *rows), spark.createDataFrame(RENAMES, RENAME_SCHEMA)
    ).orderBy("pos").collect()
    assert [(r.new_target, r.changed) for r in got] == [
        ("media/a.jpeg", True), ("../word/media/a.jpeg", True), ("/word/media/a.jpeg", True),
        ("https://h/media/a.png", False), ("media/a.png", False), (None, False), ("", False),
        ("media/A.png", False),
    ]


def test_counts_must_be_equal(spark):
    schema = "container string, paragraphs int, tables int, inline_images int"
    before = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 3), ("n", None, 2, 3)], schema)
    after = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 4), ("n", None, 2, 3)], schema)
    assert messages(rec.count_violations(before, after)) == [
        "contagens diferem: parágrafos 1 vs 1, tabelas 2 vs 2, imagens inline 3 vs 4"
    ]


def test_first_violation_and_version(spark):
    schema = "container string, rule_no int, ordinal long, subject string, message string"
    violations = spark.createDataFrame(
        [("a", 4, 7, None, "late"), ("a", 2, 9, None, "early"), ("a", 2, 3, None, "earliest")], schema
    )
    first = rec.first_violation(violations).first()
    assert (first.message, first.findings) == ("earliest", 3)
    containers = spark.createDataFrame([("a",), ("b",), ("d",)], "container string")
    done = spark.createDataFrame([("a",), ("b",)], "container string")
    got = {r.container: (r.version, r.failure) for r in
           rec.select_version(containers, violations, done).collect()}
    assert got == {"a": ("original", "earliest"), "b": ("new", None), "d": ("unchanged", None)}


def greedy(candidates, existing):
    taken, result = set(existing), {}
    for ordinal, name in candidates:
        base = name[: name.rindex(".")]
        new, k = f"{base}.jpeg", 1
        while new in taken:
            k += 1
            new = f"{base}_conv{k}.jpeg"
        taken.add(new)
        result[ordinal] = new
    return result


part = hs.builds(
    lambda base, suffix, ext: f"word/media/{base}{suffix}{ext}",
    hs.sampled_from(["a", "b"]),
    hs.sampled_from(["", "_conv2", "_conv3", "_conv2_conv2"]),
    hs.sampled_from([".png", ".PNG", ".jpeg", ".JPEG", ".gif"]),
)


@few
@given(hs.lists(hs.lists(part, min_size=1, max_size=10), min_size=1, max_size=12))
def test_names_are_those_of_a_greedy_walk(spark, packages):
    rows = [(f"c{i}", n, name) for i, names in enumerate(packages) for n, name in enumerate(names)]
    parts = spark.createDataFrame(rows, "container string, ordinal int, part_name string")
    wanted = parts.filter(F.lower("part_name").endswith(".png")).withColumn(
        "jpeg_extension", F.lit("jpeg")
    )
    got = {(r.container, r.ordinal): r.new_part_name for r in assign_names(wanted, parts).collect()}
    expected = {}
    for i, names in enumerate(packages):
        png = [(n, name) for n, name in enumerate(names) if name.lower().endswith(".png")]
        expected |= {(f"c{i}", n): new for n, new in greedy(png, names).items()}
    assert got == expected


def test_new_names_meet_taken_ones_where_nothing_is_broadcast(spark):
    rows = [(f"p{k}", i, f"word/media/a{i}.{e}") for k in range(300) for i, e in enumerate(["png", "png", "jpeg"])]
    rows += [(f"p{k}", 3, "word/media/a0.jpeg") for k in range(0, 300, 2)]
    # One root has most of the candidates, so the shuffles' partitions differ in size.
    rows += [("q", k, f"word/media/y_conv{k + 2}.png") for k in range(3000)]
    parts = spark.createDataFrame(rows, "container string, ordinal int, part_name string")
    wanted = parts.filter(F.col("part_name").endswith(".png")).withColumn("jpeg_extension", F.lit("jpeg"))
    # As at size: joins by shuffles, whose partitions adaptive execution merges.
    at_size = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "13",
               "adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {name: spark.conf.get(f"spark.sql.{name}") for name in at_size}
    try:
        for name, value in at_size.items():
            spark.conf.set(f"spark.sql.{name}", value)
        got = {(r.container, r.ordinal): r.new_part_name for r in assign_names(wanted, parts).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.{name}", value)
    assert len(got) == 3600
    for k in range(300):
        assert got[f"p{k}", 0] == ("word/media/a0.jpeg" if k % 2 else "word/media/a0_conv2.jpeg")
        assert got[f"p{k}", 1] == "word/media/a1.jpeg"


def test_numbering_is_total_and_dense(spark):
    rows = spark.range(0, 500, 1, 7).select(F.sha1(F.col("id").cast("string")).alias("name"))
    got = with_progress(rows, ["name"]).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.ordinal)] == sorted(r.name for r in got)
    assert sorted(r.ordinal for r in got) == list(range(1, 501))
    assert {r.total for r in got} == {500}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    left = spark.range(1000).select(
        F.when(F.col("id") < 700, F.lit(1)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("row"),
    ).unionByName(spark.sql("select cast(null as bigint) k, -1L row"))
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = left.join(right, "k", how)
    got = spread_join(left, right, ["k"], how, ["row"], ways=16)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_spread_join_splits_the_hot_key(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("row"))
    right = spark.createDataFrame([(1, "v")], "k int, v string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        joined = spread_join(left, right, ["k"], "inner", ["row"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) > 1 and joined.count() == 4000


def test_outcomes_and_summary(spark):
    decisions = spark.createDataFrame(
        [("a", 0, "p0", None, 100, 60, True), ("a", 1, "p1", "why", 50, None, False),
         ("b", 0, "q0", None, 10, None, None)],
        "container string, ordinal int, part_name string, reason string, old_size long, "
        "new_size long, accepted boolean",
    )
    got = {r.container: r for r in out.outcomes(decisions).collect()}
    assert (got["a"].size_before, got["a"].size_after, got["a"].processed, got["a"].skipped) == (150, 110, 1, 1)
    assert (got["b"].size_after, got["b"].processed, got["b"].skipped) == (10, 0, 0)
    decided = decisions.filter("accepted is not null")
    lines = [r.line for r in out.detail_lines(decided).orderBy("ordinal").collect()]
    assert lines == ["    - p0: 0,0 MB -> 0,0 MB", "    - p1: why"]
    results = out.outcomes(decisions).withColumn("failure", F.lit(None).cast("string"))
    total = out.corpus_summary(results).first()
    assert (total.files, total.failures, total.total_before, total.total_after) == (2, 0, 160, 120)
    none = out.corpus_summary(results.limit(0)).first()
    assert (none.files, none.total_before, none.reduction_pct) == (0, 0, 0.0)


def test_over_limit_counts_compressed_png(spark):
    results = spark.createDataFrame(
        [("a", 1000), ("b", 1001), ("d", 2000)], "container string, size_after long"
    )
    parts = spark.createDataFrame(
        [("b", "word/media/a.png", 400), ("b", "word/media/b.PNG", 100), ("b", "word/c.png", 7),
         ("b", "word/media/d.jpeg", 9)],
        "container string, part_name string, compress_size long",
    )
    got = {r.container: (r.weight, r.parts) for r in out.over_limit(results, parts, 1000).collect()}
    assert got == {"b": (500, 2), "d": (0, 0)}
    none = out.media_weight(parts, containers=results).collect()
    assert {r.container: r.parts for r in none} == {"a": 0, "b": 2, "d": 0}
