"""Market-panel operators: bars, windowed features, cross-sections, risk."""
