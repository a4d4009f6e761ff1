"""The incremental validation stream appends each batch's violations."""

import tempfile

from vectorlint.plans.registry import RegistryStore
from vectorlint.sources import fixtures as FX
from vectorlint.streaming.incremental import start


def test_stream_validates_new_files(spark, sf):
    src = tempfile.mkdtemp(prefix="vectorlint-src-")
    reg = tempfile.mkdtemp(prefix="vectorlint-reg-")
    ck = tempfile.mkdtemp(prefix="vectorlint-ck-")
    b = FX.blocks(spark, sf).select("fid", "school_name", "srid", "geom")
    b.write.mode("overwrite").parquet(src + "/batch1")
    q = start(spark, src + "/batch1", b.schema, "building", reg, ck)
    q.awaitTermination(300)
    v = RegistryStore(spark, reg).read("violations")
    assert v is not None and v.count() > 0
    assert v.where("error_type = 'OverlappingBuildings'").count() > 0
