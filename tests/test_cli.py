from lociwave.__main__ import main
from lociwave.plans import catalog


def test_list(capsys):
    main([])
    assert len(capsys.readouterr().out.splitlines()) >= len(catalog.QUERIES)


def test_run(spark, capsys, tmp_path):
    main(["pi_per_site", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
