"""reelgrain: DataFrame operators for the tables of a footage-labelling pipeline."""
