"""Table operators: windows, cross sections, joins, portfolios, regimes."""
