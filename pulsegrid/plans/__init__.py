"""End-to-end compositions: detectors and edit lists."""
