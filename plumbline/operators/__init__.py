"""The assessments: profile, quality, anomalies, distributions."""
