"""Further queries; importing this package adds them to the catalogue."""

from . import bundles, ranking, texts  # noqa: F401
