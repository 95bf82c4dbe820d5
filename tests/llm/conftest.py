import datetime as dt

import pytest

ROBOT = "array<struct<area:int,on_change:double,moving:double,at_edge:boolean,bbox:array<int>,mean:double>>"
MANIFEST = f"item_id long, clip string, frame long, robots {ROBOT}, written_at timestamp_ntz, row_id long"
COMPOSED = "image_id long, run string, robots array<struct<source:string,class_name:string,bbox:array<int>,visible:double>>, written_at timestamp_ntz, n long"
T0 = dt.datetime(2024, 1, 1)


def robot(x, y=0, w=10, h=20, area=100, mean=50.0):
    return (area, 0.5, 0.5, False, [x, y, x + w, y + h], mean)


@pytest.fixture
def manifest(spark):
    def make(rows):
        return spark.createDataFrame(rows, MANIFEST)

    return make


@pytest.fixture
def composed(spark):
    def make(rows):
        return spark.createDataFrame([(i, run, None if s is None else [(x, "other", [0, 0, 1, 1], 1.0) for x in s], T0, 7) for i, run, s in rows], COMPOSED)

    return make
