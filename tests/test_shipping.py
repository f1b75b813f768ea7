import zipfile

from fraylens.operators.staging import shared_folder
from fraylens.shipping import archive, ship


def test_archive_holds_the_package(tmp_path):
    names = zipfile.ZipFile(archive(str(tmp_path))).namelist()
    assert "fraylens/__init__.py" in names and "fraylens/operators/pullfold.py" in names


def test_workers_import_the_shipped_package(spark):
    ship(spark)

    def where(batches):
        import fraylens.operators.pullfold  # noqa: F401

        yield from batches

    assert spark.range(3).mapInArrow(where, "id long").count() == 3


def test_local_mode_gets_a_folder(spark):
    assert shared_folder(spark)
