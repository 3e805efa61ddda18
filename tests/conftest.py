import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from balanza.session import build_session  # noqa: E402

LEDGER = (
    "fecha_corte date, segmento string, ruc string, razon_social string, cuenta string, "
    "descripcion_cuenta string, saldo_usd decimal(20,4), anio string"
)
CUT = dt.date(2025, 12, 31)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_ledger(spark):
    def build(entities, cut=CUT, segmento="SEGMENTO 1", name="COOPERATIVA {} LTDA"):
        rows = [
            (cut, segmento, ruc, name.format(ruc), cuenta, "CUENTA " + cuenta, Decimal(str(saldo)), str(cut.year))
            for ruc, balances in entities.items()
            for cuenta, saldo in balances.items()
        ]
        return spark.createDataFrame(rows, LEDGER)

    return build


# Hand-computed entities: sound, stressed, empty, negative equity.
ENTITIES = {
    "E1": {"1": 1000, "2": 850, "3": 150, "11": 100, "13": 60, "14": 700, "1499": -42, "1425": 14, "1449": 7,
           "21": 600, "4": 80, "41": 30, "45": 35, "5": 100, "51": 75},
    "E2": {"1": 1000, "2": 960, "3": 40, "11": 30, "14": 800, "1499": -50, "1425": 80, "1449": 40, "21": 700,
           "4": 110, "41": 60, "45": 60, "5": 100, "51": 70},
    "E3": {"1": 0, "3": 10},
    "E4": {"1": 500, "2": 520, "3": -20, "11": 50, "13": 20, "14": 300, "21": 400, "4": 10, "5": 10},
}


@pytest.fixture(scope="session")
def entities_ledger(make_ledger):
    return make_ledger(ENTITIES)
