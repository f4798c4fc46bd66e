"""soundframe: a catalogue of audio clips and their signals as Spark DataFrames."""
