"""One object with all operators by theme."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import SparkSession


class Sheaf:
    """``Sheaf(spark).text.lexical_richness(df)`` and so on; modules load when first used."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @property
    def gather(self) -> SimpleNamespace:
        from sheaf.operators import gather

        return SimpleNamespace(rows=gather.gather_rows, groups=gather.gather_groups, row_ids=gather.with_row_ids)

    @property
    def text(self) -> SimpleNamespace:
        from sheaf.operators import dictionary, lexical, readability, vectors

        return SimpleNamespace(lexical_richness=lexical.lexical_richness, readability=readability.readability, dictionaries=dictionary.code,
                               load_dictionaries=dictionary.load_lexicons, one_text=lambda text, lexicons, **how: dictionary.code_text(self.spark, text, lexicons, **how),
                               archetypes=vectors.archetype_scores, archetype_texts=vectors.score_archetypes, sentence_vectors=vectors.sentence_vectors,
                               sentence_embeddings=vectors.sentence_embeddings, mean_pool=vectors.mean_pool)

    @property
    def features(self) -> SimpleNamespace:
        from sheaf.operators import features

        return SimpleNamespace(aggregate=features.aggregate_features, union=features.union_by_name, plan=features.AggregationPlan, weighted_mean=features.weighted_mean)

    @property
    def intervals(self) -> SimpleNamespace:
        from sheaf.operators import intervals, speech

        return SimpleNamespace(**{n: getattr(intervals, n) for n in ("merge_turns", "word_speakers", "merge_untimed", "voiced_segments", "segment_stats", "pause_metrics", "fixed_windows", "embedding_windows", "turn_summary")}, utterances=speech.speaker_utterances, realigned=speech.realigned_words)

    @property
    def audio(self) -> SimpleNamespace:
        from sheaf.operators import media, sound, speech, transcripts, voice

        return SimpleNamespace(acoustics=sound.acoustics, voices=voice.analyze, framewise=voice.framewise, turns=transcripts.valid_turns, speaker_sounds=transcripts.speaker_sounds,
                               turn_acoustics=transcripts.turn_acoustics, turn_voices=transcripts.turn_voices, to_wav=media.convert, streams=media.split_streams,
                               segment_embeddings=media.segment_embeddings, turn_embeddings=media.turn_embeddings, backend=speech.run_backend,
                               register_backend=speech.register_backend)

    @property
    def calls(self) -> SimpleNamespace:
        """Calls on files, as presets and the command line make them."""
        from sheaf.plans import calls

        return SimpleNamespace(**{n: getattr(calls, n) for n in calls.THEMES}, register_encoder=calls.register_encoder)

    @property
    def files(self) -> SimpleNamespace:
        from sheaf.sources import files, subtitles

        return SimpleNamespace(csv=files.read_csv, csvs=files.gather_csvs, texts=files.read_texts, find=files.find_files, inputs=files.discover_inputs, subtitles=subtitles.read_subtitles, convert_subtitles=subtitles.convert)
