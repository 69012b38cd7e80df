import pytest

from ledgerloom.operators.cost import fingerprint
from ledgerloom.operators.funding import FundingConfig
from ledgerloom.operators.generator import GenConfig, generate
from ledgerloom.plans.analysis import worst_case
from ledgerloom.sources import ledger_json, manifest
from ledgerloom.sources.personas import export_presets, from_toml, load_personas, presets, to_toml
from ledgerloom.streaming.ingest import ingest

SMALL = GenConfig(agents=6, days=1)


@pytest.fixture(scope="module")
def made(spark):
    return {m: generate(spark, presets(), GenConfig(agents=6, days=1, mode=m)).persist() for m in ("naive", "cooker")}


def test_json_round_trip(spark, made, tmp_path):
    ledger = made["cooker"].limit(50)
    ledger_json.ledger_document(ledger).write.text(str(tmp_path / "doc"))
    back = ledger_json.read_ledger(spark, str(tmp_path / "doc"))
    assert sorted(map(tuple, back.drop("pos").collect())) == sorted(map(tuple, ledger.select(*back.drop("pos").columns).collect()))


def test_too_large_amounts_fail(spark, tmp_path):
    ids = "[" + ",".join(["1"] * 32) + "]"
    line = f'{{"sig":1,"slot":1,"ts":1,"fee_payer":{ids},"source":{ids},"dest":{ids},"amount":18446744073709551615,"kind":"memo","operator":null}}'
    (tmp_path / "j").write_text(line + "\n")
    with pytest.raises(Exception, match="exceeds"):
        ledger_json.read_journal(spark, str(tmp_path / "j")).collect()


def test_journal_prefix_and_stream(spark, made, tmp_path):
    ledger = made["cooker"].orderBy("sig").limit(40)
    ledger_json.append_journal(ledger, str(tmp_path / "journal"))
    (tmp_path / "journal" / "part-torn.json").write_text('{"sig": 41, "slot"')
    n = ledger.count()
    assert ledger_json.read_journal(spark, str(tmp_path / "journal"), n - 5).count() == n - 5
    with pytest.raises(ValueError):
        ledger_json.read_journal(spark, str(tmp_path / "journal"), n + 1)
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(tmp_path / "journal"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_manifest(spark, tmp_path):
    said = manifest.run_manifest(presets(), SMALL, 7)
    manifest.save_manifest(spark, str(tmp_path / "m"), said)
    assert manifest.load_manifest(spark, str(tmp_path / "m"), said) == said
    with pytest.raises(ValueError):
        manifest.load_manifest(spark, str(tmp_path / "m"), manifest.run_manifest(presets()[:1], SMALL))


def test_personas(tmp_path):
    assert [from_toml(to_toml(p)) for p in presets()] == presets()
    export_presets(str(tmp_path))
    assert {p.name for p in load_personas([str(tmp_path)])} == {"retail", "whale", "market_maker"}
    with pytest.raises(ValueError):
        load_personas([str(tmp_path), str(tmp_path / "whale.toml")])
    with pytest.raises(ValueError, match="positive"):
        from_toml(to_toml(presets()[0]).replace("num_subaccounts = 4", "num_subaccounts = 0"))


def test_generator(spark, made):
    again = generate(spark, presets(), SMALL).repartition(7)
    assert fingerprint(again).first() == fingerprint(made["cooker"]).first()
    ts = [r["ts"] for r in made["cooker"].orderBy("slot").select("ts").collect()]
    assert ts == sorted(ts)
    naive, hardened = (worst_case(made[m]).first()["worst_f1"] for m in ("naive", "cooker"))
    assert naive > 0.9 and hardened < naive


def test_funding_is_a_suffix(spark, made):
    cfg = GenConfig(agents=6, days=1, funding=FundingConfig("shared_relayers"))
    funded, base = generate(spark, presets(), cfg), made["cooker"]
    n = base.count()
    assert fingerprint(funded.filter(f"pos <= {n}")).first() == fingerprint(base).first()
    assert funded.count() > n and funded.agg({"slot": "max"}).first()[0] == funded.count()
