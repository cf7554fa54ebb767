"""The command line maps arguments to jobs."""

import pytest

from lendwell import schemas
from lendwell.__main__ import parser, run
from lendwell.operators.quality import DataQualityError
from lendwell.sources import tables


def test_etl_and_check(spark, small, tmp_path):
    staging = str(tmp_path / "staging")
    tables.overwrite_staging(dict(zip(schemas.STAGING, small.staging)), staging)
    args = parser().parse_args(["etl", "--staging", staging, "--features", str(tmp_path / "features")])
    assert run(args, spark) == 1500
    with pytest.raises(DataQualityError):
        run(parser().parse_args(["check", "--staging", staging]), spark)


def test_unknown_job():
    with pytest.raises(SystemExit):
        parser().parse_args(["dance"])
