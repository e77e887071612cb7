"""Part of hammerline."""
