"""Per-class routers: training, calibration and scoring."""
