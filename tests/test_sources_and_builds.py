import json

import pytest
from conftest import rows
from helpers import chain, comp, config, entry, table
from pyspark.sql import functions as F

from partita.config import Fractions
from partita.operators import audit, sampling
from partita.plans import build, cli
from partita.plans.loader import Partition
from partita.sources import documents as files
from partita.sources import entries as src
from partita.sources import fetch
from partita.streaming.growth import grow

RAW = {
    "rcsb_id": "1ABC", "exptl": [{"method": "X-RAY DIFFRACTION"}], "rcsb_entry_info": {"resolution_combined": [2.5, 1.74], "deposited_polymer_monomer_count": 300, "nonpolymer_bound_components": ["hem"]},
    "rcsb_accession_info": {"initial_release_date": "1984-07-17T00:00:00Z"}, "rcsb_binding_affinity": None,
    "polymer_entities": [
        {"rcsb_id": "1ABC_2", "entity_poly": {"rcsb_entity_polymer_type": "Protein", "pdbx_seq_one_letter_code_can": "ACD\nEF G"}, "rcsb_cluster_membership": [{"cluster_id": 48, "identity": 30}, {"cluster_id": 49, "identity": 30}, {"cluster_id": None, "identity": 50}],
         "rcsb_polymer_entity_annotation": [{"type": "Pfam", "annotation_id": "PF2", "name": "nickel binding"}, {"type": "Pfam", "annotation_id": "PF1", "name": None}],
         "polymer_entity_instances": [{"rcsb_polymer_instance_annotation": [{"type": "CATH", "annotation_id": "1.10", "name": None}, {"type": "ECOD", "annotation_id": "e1", "name": None}, {"type": "SCOP2", "annotation_id": "x", "name": "Globin"}]}]},
        {"rcsb_id": "1ABC_1", "entity_poly": {"rcsb_entity_polymer_type": None, "pdbx_seq_one_letter_code_can": None}, "rcsb_cluster_membership": None, "rcsb_polymer_entity_annotation": None, "polymer_entity_instances": None},
    ],
    "nonpolymer_entities": [
        {"nonpolymer_comp": {"chem_comp": {"id": "PO4", "name": "p", "formula": "O4 P", "type": "non-polymer"}}, "nonpolymer_entity_instances": None},
        {"nonpolymer_comp": {"chem_comp": {"id": "hem", "name": "first", "formula": "C34", "type": "non-polymer"}}, "nonpolymer_entity_instances": [{"rcsb_nonpolymer_instance_validation_score": [{"is_subject_of_investigation": "Y"}]}]},
        {"nonpolymer_comp": {"chem_comp": {"id": "HEM", "name": "second", "formula": "C34", "type": "non-polymer"}}, "nonpolymer_entity_instances": None},
    ],
    "assemblies": [{"rcsb_id": "1ABC-1", "rcsb_assembly_info": {"polymer_monomer_count": 574, "num_prot_na_interface_entities": 1}}, {"rcsb_id": "1ABC-2", "rcsb_assembly_info": None}],
    "pdbx_vrpt_summary_geometry": [{"clashscore": 142.32, "percent_ramachandran_outliers": None, "percent_rotamer_outliers": None}], "pdbx_vrpt_summary_diffraction": None, "pdbx_vrpt_summary_em": [],
}


def test_raw_objects_become_entries(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(RAW))
    got = src.parse_raw(spark.read.schema(src.RAW_SCHEMA).json(str(tmp_path / "raw.json"))).first().asDict(recursive=True)
    assert (got["entry_id"], got["methods"], got["resolution_A"], got["release_date"]) == ("1ABC", ["X-RAY DIFFRACTION"], 1.74, "1984-07-17")
    assert got["assemblies"] == {"1ABC-1": 574} and got["protein_na_interface_count"] == 1 and got["bound_components"] == ["HEM"] and got["affinity_comp_ids"] == [] and got["investigated_comp_ids"] == ["HEM"]
    first, second = got["polymer_entities"]
    assert first["entity_id"] == "1ABC_1" and first["polymer_type"] == "Other" and first["seq"] == ""
    assert second["seq"] == "ACDEFG" and second["seq_len"] == 6 and second["cluster_ids"] == {"30": 49} and second["metal_annotations"] == ["NI"]
    assert second["structural_families"] == {"cath": ["1.10"], "scop2": ["Globin"]} and second["domain_families"] == {"pfam": ["PF1", "PF2"]}
    assert [(c["comp_id"], c["name"]) for c in got["nonpolymer_comps"]] == [("HEM", "first"), ("PO4", "p")]
    assert got["quality"]["clashscore"] == 142.32 and got["quality"]["rfree"] is None


def test_enumeration(spark, tmp_path):
    from partita.sources import enumerate as enum

    every = [f"{k}ABC" for k in range(1, 8)]
    cfg = config(experimental_methods=("X-ray diffraction", "solution NMR"))
    failed = []

    def search(_, start, n):
        if start == 3 and not failed:
            failed.append(start)
            raise fetch.TransportError("busy", 503)
        return every[start : start + n]

    raw = json.dumps(RAW)

    def ask(ids):
        return json.dumps({"data": {"entries": [None if x == "3ABC" else json.loads(raw) | {"rcsb_id": x} for x in ids]}, "errors": [{"message": "3ABC is gone"}]})

    with pytest.warns(UserWarning, match="SOLUTION NMR"):
        told = enum.enumerate_entries(spark, cfg, search, ask, str(tmp_path / "e"), page=3, batch=2)
    assert (told["found"], told["count"]) == (7, 6) and failed == [3]
    assert [r[0] for r in rows(src.read_entries_jsonl(spark, str(tmp_path / "e")).select("entry_id"))] == [x for x in every if x != "3ABC"]
    assert list(enum.search_pages(cfg, search, limit=5, page=3)) == [every[:3], every[3:5]] and list(enum.search_pages(cfg, lambda *a: [])) == []
    with pytest.raises(fetch.TransportError, match="no data"):
        enum.records_of('{"errors": ["bad query"]}', ["1ABC"])


def test_canonical_lines_round_trip(spark, tmp_path):
    entries = table(spark, [entry("B", comps=[comp("É", None)]), entry("A", resolution_A=1e-5)])
    src.write_entries_jsonl(entries, str(tmp_path / "e"))
    back = src.read_entries_jsonl(spark, str(tmp_path / "e"))
    assert src.content_fingerprint(back) == src.content_fingerprint(entries) and src.content_fingerprint(entries.where("entry_id = 'A'")) != src.content_fingerprint(entries)
    line = src.canonical_lines(entries).where("entry_id = 'B'").first()["line"]
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":")) and "\\u00c9" in line and '"rfree":null' in line
    (tmp_path / "bad.jsonl").write_text(line + "\n\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        src.read_entries_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_scan_and_annotations(spark):
    entries = table(spark, [entry("A"), entry("B", release_date="2027-01-01"), entry("C", methods=["NMR"]), entry("D", resolution_A=9.0), entry("E")])
    assert src.count_entries(entries, config()) == 2 and [r.entry_id for r in src.scan(entries, config(), 1).collect()] == ["A"]
    cache = spark.createDataFrame([("A_1", ["PF9"], None)], "entity_id string, pfam array<string>, interpro array<string>")
    got = {r.entry_id: r.polymer_entities[0].domain_families for r in src.with_annotations(entries, cache).collect()}
    assert got["A"] == {"pfam": ["PF9"]} and got["B"] == {}


@pytest.mark.parametrize("strategy", ["hash", "balanced", "maximal"])
def test_build_verify_load(spark, tmp_path, strategy):
    zn = comp("ZN", "Zn 2+")
    entries = table(spark, [entry(f"E{k:03}", [chain(f"E{k:03}_1", "ACDEFGHIKLMNPQRS" + "ACDEFGHIKL"[k % 10] * (k // 2 + 1), k // 2, structural={"cath": [f"f{k // 8}"]})], [zn], bound_components=["ZN"]) for k in range(60)])
    cfg = config(split_strategy=strategy, fold_benchmark_method="cath", test_min_per_class={"metal": 2} if strategy != "balanced" else {})
    b = build.run_build(entries, cfg)
    lock = build.write_build(entries, b, tmp_path)
    assert build.verify(entries, json.loads(json.dumps(lock))) == (0, ["certified"])
    assert build.verify(entries.where("entry_id <> 'E001'"), lock)[0] == 1 and build.verify(entries, lock | {"source": "resplit"}, online=True)[0] == 2
    manifest = files.read_json(tmp_path / build.MANIFEST)
    assert sum(c["entries"] for c in manifest["counts"].values()) == 60 and "train" in build.summary(manifest, cfg)
    p = Partition(spark, tmp_path)
    assert p.train.count() + p.val.count() + p.test.count() == 60
    view = p.train
    assert view.with_class("metal").count() == view.count() == view.conditioned_entries().count() and view.targets_by_entry().count() == view.count()
    assert view.sample_by_cluster(1).count() == view.entries.select("component").distinct().count()
    weights = view.redundancy_weights()
    assert abs(weights.agg(F.sum("weight")).first()[0] - view.sample_by_sequence(1).count()) < 1e-9
    assert view.novel_entries().count() == 0
    fetched = spark.createDataFrame([("E001", "x", "y"), ("gone", "x", "y")], "entry_id string, path string, sha256 string")
    assert p.index(fetched).where("entry_id = 'gone'").first()["classes"] == []
    with pytest.raises(FileNotFoundError):
        p.split("extra")
    registry = spark.read.parquet(str(tmp_path / "registry"))
    again = build.run_build(entries, cfg, registry)
    assert again.outcome["pinned_reassignments"] == 0 and rows(again.splits) == rows(b.splits)
    assert (build.resolve_registry(tmp_path, cfg) is not None) == (strategy != "hash") and build.resolve_registry(tmp_path, cfg, fresh=True) is None


def test_command_line(spark, tmp_path, capsys):
    src.write_entries_jsonl(table(spark, [entry(f"E{k}", [chain(f"E{k}_1", "ACDEFGHIKLMNP" + "C" * k, k)]) for k in range(12)]), str(tmp_path / "e"))
    (tmp_path / "c.json").write_text(json.dumps(config().canonical()))
    paths = [str(tmp_path / x) for x in ("c.json", "e", "out")]
    assert cli.main(["build", *paths, "--count"]) == 0 and capsys.readouterr().out.strip() == "12"
    assert cli.main(["build", *paths]) == 0 and cli.main(["verify", paths[2], paths[1]]) == 0 and cli.main(["stats", paths[2]]) == 0 and cli.main(["spec", paths[0]]) == 0
    assert cli.main(["build", str(tmp_path / "none.json"), *paths[1:]]) == 2


def test_documents_on_disk(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",)], "entry_id string")
    assert files.read_id_list(files.write_id_list(tmp_path / "ids.json", ids)) == ["a", "b"]
    assert (files.write_id_list(tmp_path / "none.json", ids.limit(0))).read_text() == "[]\n" and files.read_id_list(tmp_path / "gone.json") == []
    files.write_json(tmp_path / "late.json", ["A", "c"])
    got = files.combine_lists(spark, [(str(tmp_path / "ids.json"), "train", None), (str(tmp_path / "late.json"), "test", "metal")])
    assert rows(got) == [("A", "test", "metal"), ("B", "train", None), ("C", "test", "metal")]
    (tmp_path / "x.json").write_text('{"1abc": {"split": "valid", "test_class": null}}')
    assert rows(files.read_external_split(spark, str(tmp_path / "x.json"))) == [("1ABC", "valid", None)]
    (tmp_path / "chains.csv").write_text("CHAINID,CLUSTER\n1abc_A,7\n2xyz_B,8\n")
    (tmp_path / "test.txt").write_text("7\n\n")
    assert rows(files.read_chain_lists(spark, str(tmp_path / "chains.csv"), {"test": str(tmp_path / "test.txt")})) == [("1abc_A", "7", "test"), ("2xyz_B", "8", "train")]
    cache = spark.createDataFrame([("a",)], "entity_id string")
    files.append_to_cache(cache, str(tmp_path / "cache"))
    (tmp_path / "cache" / "part-torn.json").write_text('{"entity_id": "zz')
    want = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert rows(files.missing_from_cache(spark, want, str(tmp_path / "cache"), "entity_id string")) == [("b",)]


def test_fetching_is_retried_and_failures_are_rows(spark):
    import gzip

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise fetch.TransportError("busy", 503)
        return 7

    assert fetch.with_retries(flaky, sleep=lambda s: None) == 7
    with pytest.raises(fetch.TransportError):
        fetch.with_retries(lambda: (_ for _ in ()).throw(fetch.TransportError("no", 404)), sleep=lambda s: None)
    ids = spark.createDataFrame([("a",), ("b",)], "entry_id string")
    assert rows(fetch.fetch_records(ids, lambda part: [None if x == "a" else f'{{"rcsb_id": "{x}"}}' for x in part])) == [('{"rcsb_id": "b"}',)]
    splits = spark.createDataFrame([("1ABC", "test"), ("2XYZ", "train"), ("3DEF", "val")], "entry_id string, split string")
    there = spark.createDataFrame([("structures/val/de/3def.cif.gz",)], "path string")
    got = fetch.fetch_files(splits, there, lambda url: gzip.compress(b"x") if "1abc" in url else b"junk", lambda p, b: None, "https://files.example.org")
    assert [(r.entry_id, r.path, r.error is None) for r in got.orderBy("entry_id").collect()] == [("1ABC", "structures/test/ab/1abc.cif.gz", True), ("2XYZ", "structures/train/xy/2xyz.cif.gz", False)]
    assert fetch.estimate_bytes(ids, lambda x: 10) == 20


def test_samples_and_audits(spark):
    df = spark.createDataFrame([(f"e{k}", f"g{k % 3}") for k in range(30)], "entry_id string, g string")
    a, b = rows(sampling.sample_one_per_group(df, "g", 1)), rows(sampling.sample_one_per_group(df.repartition(7), "g", 1))
    assert a == b and len(a) == 3 and a != rows(sampling.sample_one_per_group(df, "g", 2))
    assert sampling.stride_sample(df, "entry_id", 7).count() == 7 and sampling.stride_sample(df, "entry_id", 99).count() == 30
    assert rows(sampling.seeded_sample(df, "entry_id", 5, 1, "blake2b")) == rows(sampling.seeded_sample(df.repartition(5), "entry_id", 5, 1, "blake2b"))
    lists = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2), ("z", 3)], "list string, id int")
    assert rows(audit.list_overlaps(lists)) == [("x", "y", 1), ("x", "z", 0), ("y", "z", 0)] and rows(audit.list_sizes(lists))[0] == ("x", 3, 2, 1)


def test_growth_keeps_prior_splits(spark):
    first = spark.createDataFrame([("A", "k1"), ("B", "k2")], "entry_id string, raw_key string")
    fractions = Fractions(0.8, 0.1, 0.1)
    start = grow(first, spark.createDataFrame([("k1", "test")], "raw_key string, split string"), fractions, "s")
    assert ("k1", "test") in rows(start)
    merged = grow(first.union(spark.createDataFrame([("C", "k1"), ("C", "k2")], "entry_id string, raw_key string")), start, fractions, "s")
    assert rows(merged) == [("k1", "test"), ("k2", "test")]


def test_fetch_command(spark, tmp_path):
    import gzip
    import json

    spark.createDataFrame([("1ABC", "k", "test"), ("2XYZ", "m", "train"), ("9", "n", "val")], "entry_id string, component string, split string").write.parquet(str(tmp_path / "entries.splits"))
    spark.createDataFrame([("2XYZ", ["metal"], {"ZN": "functional"})], "entry_id string, classes array<string>, tiers map<string,string>").write.parquet(str(tmp_path / "entries.classes"))
    spark.createDataFrame([("9", "metal", "ZN", "functional", "bound")], "entry_id string, class string, comp_id string, tier string, reason string").write.parquet(str(tmp_path / "targets"))
    (tmp_path / "manifest.json").write_text(json.dumps({"dataset_version": "v", "config_hash": "h", "counts": {s: {"entries": 1, "components": 1, "sequence_groups": 1} for s in ("train", "val", "test")}}))
    for name in ("train", "val", "test"):
        (tmp_path / f"{name}.json").write_text("[]")
    asked = []

    def get(url):
        asked.append(url)
        (tmp_path / "asked").open("a").write(url + "\n")
        return gzip.compress(b"x")

    urls = lambda: sorted((tmp_path / "asked").read_text().split()) if (tmp_path / "asked").exists() else []
    assert cli.main(["fetch", str(tmp_path)]) == cli.REFUSED and cli.main(["fetch", str(tmp_path), "--estimate"]) == cli.NOT_IMPLEMENTED
    assert cli.main(["fetch", str(tmp_path), "--split", "test", "--base-url", "https://x.org"], transport=get) == 0
    assert (tmp_path / "structures/test/ab/1abc-assembly1.cif.gz").exists() and spark.read.parquet(str(tmp_path / "index")).count() == 1 and urls() == ["https://x.org/1abc-assembly1.cif.gz"]
    assert cli.main(["fetch", str(tmp_path), "--classes", "metal", "--base-url", "https://x.org"], transport=get) == 0 and urls()[1:] == ["https://x.org/2xyz-assembly1.cif.gz"]
    assert cli.main(["fetch", str(tmp_path), "--targets", "metal", "--base-url", "https://x.org"], transport=get) == 0 and len(urls()) == 3
    lines = [json.loads(x) for x in (tmp_path / "index.jsonl").read_text().splitlines()]
    assert [x["entry_id"] for x in lines] == ["1ABC", "2XYZ", "9"] and lines[1]["classes"] == ["metal"] and lines[2]["conditioning_targets"][0]["comp_id"] == "ZN" and lines[2]["path"].startswith("structures/val/")
    assert "| train | 1 | 1 | 1 | 1 |" in (tmp_path / "README.md").read_text()
    # What is there and intact stays; what was changed is fetched again.
    (tmp_path / "structures/test/ab/1abc-assembly1.cif.gz").write_bytes(b"broken")
    assert cli.main(["fetch", str(tmp_path), "--base-url", "https://x.org"], transport=get) == 0 and len(urls()) == 4
    assert cli.main(["fetch", str(tmp_path), "--deposited", "--limit", "1"], transport=lambda url: b"junk") == cli.NETWORK


def test_builds_tell_what_moved(spark, tmp_path):
    from partita.plans import build

    before = spark.createDataFrame([("A", "k", "train"), ("B", "m", "test"), ("C", "n", "val")], "entry_id string, component string, split string")
    assert build.migration(tmp_path, before) == {}
    before.write.parquet(str(tmp_path / "entries.splits"))
    after = spark.createDataFrame([("A", "k", "test"), ("B", "m", "train"), ("D", "n", "val")], "entry_id string, component string, split string")
    assert build.migration(tmp_path, after) == {"moved": 2, "into_train": 1, "out_of_train": 1, "common": 2}


def test_run_spans_and_short_paths(spark):
    from hashlib import blake2b

    from partita.functions import text

    seqs = ["HHHHAA", "A" * 18 + "HHHH" + "A" * 30, "A" * 17 + "HHHH" + "A" * 30, "A" * 16 + "HHHHH" + "A" * 30, "A" * 40 + "hhhh", "A" * 60, "", "A" * 30 + "HHHHHH" + "A" * 30, "HHHAHHHH"]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, s string").orderBy("k").select(text.run_spans(F.col("s"))).collect()]
    assert got == [[(1, 4)], [], [], [(17, 21)], [(41, 44)], [], [], [], [(5, 8)]]
    df = spark.createDataFrame([("A_1", "AB", 1, 4), ("A_B_2", "4HHB", 0, 0)], "c string, e string, x int, n int")
    assert rows(df.select(text.entry_of_chain(F.col("c")), text.relative_path(F.col("e"), F.lit("val"), False), text.percent(F.col("x"), F.col("n")))) == [
        ("A", f"structures/val/{blake2b(b'ab', digest_size=1).hexdigest()}/ab.cif.gz", 25.0), ("A_B", "structures/val/hh/4hhb.cif.gz", 0.0)]


def test_views_without_groups(spark):
    from partita.plans.loader import View

    entries = spark.createDataFrame([("A", "k"), ("B", "k")], "entry_id string, component string")
    folds = spark.createDataFrame([("A", ["f"], True), ("B", ["g", "h"], False)], "entry_id string, families array<string>, novel boolean")
    view = View(entries, entries, entries, None, folds)
    assert rows(view.sample_by_sequence()) == [("A",), ("B",)] and rows(view.redundancy_weights()) == [("A", 1.0), ("B", 1.0)]
    assert view.is_novel_fold("A") and not view.is_novel_fold("B") and view.folds_of("B") == ["g", "h"] and view.folds_of("C") == []


def test_settings_are_rewritten_in_place(tmp_path):
    from partita.plans import progress, wizard

    text = "# head\nresolution_max_A: 3.5  # loosest\nsplit_fractions: {}\nsplit_strategy: hash\nstructural_clustering: off\nsplit_salt: x\n"
    assert wizard.rewrite(text, {"resolution_max_A": 3.0}).splitlines()[:2] == ["# head", "resolution_max_A: 3.0  # loosest"]
    with pytest.raises(ValueError):
        wizard.rewrite(text, {"other": 1})
    said = iter(["-1", "2.5", "", "best", "balanced", "", "salty"])
    out = wizard.run_init(text, tmp_path / "c.yaml", lambda q: next(said)).read_text()
    assert "resolution_max_A: 2.5  # loosest" in out and 'split_strategy: "balanced"' in out and 'split_salt: "salty"' in out
    assert progress.duration(59) == "59s" and progress.duration(61) == "1m01s" and progress.duration(7260) == "2h01m" and progress.progress_line(1, 2, 10) == "1/2 (50.0 %) in 10s, 10s left"
    assert "| test | 1 | 1 | 1 | 0 |" in progress.dataset_card({"dataset_version": "v", "config_hash": "h", "counts": {"test": {"entries": 1, "components": 1, "sequence_groups": 1}}})
