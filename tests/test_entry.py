"""The driver contract: entry runs, twins belong to queries, and the rest works without the optional subpackage."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_imports_without_the_optional_folder():
    code = (
        "import sys; sys.path.insert(0, %r); sys.modules['tapeloom.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert e.llm_queries is None and not [q for q in e.queries() if q.startswith('op')]\n"
        "assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100" % REPO
    )
    subprocess.run([sys.executable, "-B", "-c", code], check=True)


def test_rest_imports_without_a_dependency_of_the_optional_folder():
    code = (
        "import sys, warnings; sys.path.insert(0, %r); sys.modules['public_tokenizers'] = None\n"
        "with warnings.catch_warnings(record=True) as seen:\n"
        "    warnings.simplefilter('always')\n"
        "    import __spark_entry__ as e\n"
        "assert any('public_tokenizers' in str(w.message) for w in seen), seen\n"
        "assert e.llm_queries is None and e.corpus_pipeline is None and 'pipeline' not in e.queries()\n"
        "assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100" % REPO
    )
    subprocess.run([sys.executable, "-B", "-c", code], check=True)


def test_nothing_else_imports_the_optional_folder():
    for top, _, names in os.walk(os.path.join(REPO, "tapeloom")):
        if os.sep + "llm" in top:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(top, name)) as f:
                    assert "llm" not in f.read(), name
