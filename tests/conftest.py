import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from rankweave.session import build_session
    ckpt = tempfile.mkdtemp(prefix="rankweave-test-ckpt-")
    s = build_session("rankweave-tests", master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ref_lex():
    from rankweave.functions.lexicon import reference_lexicon
    return reference_lexicon()


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
