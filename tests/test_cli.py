import contextlib
import io

from warung.__main__ import main
from warung.plans import catalog


def test_cli_lists_every_registered_view():
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["--list"]) == 0
    listed = {line.split()[0] for line in buf.getvalue().splitlines() if line.strip()}
    assert listed == set(catalog.REGISTRY)


def test_cli_rejects_unknown_view(capsys):
    assert main(["no_such_view"]) == 2
    assert "unknown view" in capsys.readouterr().err
