import json
import random

from audiolake.llm import turns as T

PEOPLE = [(1, "Ana Maria Lopes", "host"), (2, "Jo Brandt", "guest"), (3, "Kim Weller", "cohost")]


def who(content, mime="text/plain", url="x.txt", people=PEOPLE):
    return [(a, c) for a, _, c in T.turns_of(content, mime, url, people)]


def test_srt_out_of_order_and_repeated():
    content = "1\r\n00:00:05,000 --> 00:00:06,000\r\nJO: second um, line\r\n\r\n2\r\n00:00:01,000 --> 00:00:02,000\r\nHost: first\r\n\r\n3\r\n00:00:07,000 --> 00:00:08,000\r\nstill Jo\r\n\r\n3\r\n00:00:07,000 --> 00:00:08,000\r\nstill Jo\r\n"
    assert who("﻿" + content, "application/srt", None) == [(1, "first"), (2, "second line still Jo")]


def test_vtt_tags_notes_and_sounds():
    content = "WEBVTT\n\nNOTE x\ny\n\n00:01.000 --> 00:02.000\n<v Kim Weller>hello <i>all</i>\n\n00:03.000 --> 00:04.000\n[LAUGHTER]\n\n00:05.000 --> 00:06.000\n[SPEAKER_02] Um. Uh...\n\n00:07.000 --> 00:08.000\nyes"
    assert who(content, None, None) == [(3, "hello all"), (2, "yes")]  # a cue without speech still names the speaker


def test_json_whole_cut_and_bare_numbers():
    items = [{"startTime": 2.0, "body": "b", "speaker": "2"}, {"startTime": 1.0, "body": "a", "speaker": "A. Lopes"}, {"startTime": 3, "body": "c", "speaker": ""}]
    whole = json.dumps({"segments": items})
    assert who(whole, "text/html") == [(1, "a"), (2, "b c")]
    assert who(whole[:-2], "application/json") == [(1, "a"), (2, "b c")]


def test_text_forms_and_false_labels():
    assert who("Ana Lopes: hi\nFun fact: no label\nbrandt: yes") == [(1, "hi Fun fact: no label"), (2, "yes")]
    assert who("[00:00:09] Kim: later\n[00:00:01] Speaker 1: first\ncontinued") == [(1, "first continued"), (3, "later")]
    assert who("JO BRANDT 00:00:02\none\n\ntwo\n\nKim Weller 00:00:05\nthree") == [(2, "one two"), (3, "three")]
    assert who("Kim (00:00:03): x\nJo Brnadt (00:00:04): y") == [(3, "x"), (2, "y")]  # swapped letters


def test_missing_things():
    assert who(None) == who("") == who("um, uh...") == who("[music]") == []
    assert who("hello", people=[]) == []
    assert who("hello") == []  # nobody is named
    assert who("hello", people=[(4, None, None)]) == [(4, "hello")]


def test_order_drops_contradicting_file_edges():
    assert T.order([3.0, None, 1.0, None, 2.0]) == [2, 3, 4, 0, 1]
    assert T.order([None, None, None]) == [0, 1, 2]
    assert T.order([1.0, 1.0, 0.5]) == [2, 0, 1]
    assert T.order([]) == []


def test_several_speakers_in_one_cue():
    content = "1\n00:00:01,000 --> 00:00:02,000\n- Ana Lopes: one\ngoes on\n- JO: two\n\n2\n00:00:03,000 --> 00:00:04,000\nstill Jo\n\n3\n00:00:05,000 --> 00:00:06,000\n- Kim: three\n- Jo: (laughs)\n\n4\n00:00:07,000 --> 00:00:08,000\nfour"
    assert who(content, "application/srt") == [(1, "one goes on"), (2, "two still Jo"), (3, "three"), (2, "four")]
    assert who("WEBVTT\n\nc0\n00:01.000 --> 00:02.000\n<v Ana>Mm, one.</v>\n<v JO>two</v> <v Kim Weller>three</v>") == [(1, "one."), (2, "two"), (3, "three")]


def test_order_of_conflicting_edges():
    assert T.order([1.0, 1.0, 1.0], numbers=[3, 1, 2]) == [1, 2, 0]  # numbers before the file
    assert T.order([2.0, 1.0], numbers=[1, 2]) == [1, 0]  # times before numbers
    assert T.order([None, None, None], numbers=[2, None, 1]) == [2, 0, 1]  # an edge of the file is dropped
    assert T.order([5.0, 5.0, 5.0, 1.0], cues=[0, 0, 1, 2], numbers=[9, 9, 4, 1]) == [3, 2, 0, 1]  # lines of a cue stay together
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 12)
        starts = [rng.choice([None, *range(5)]) for _ in range(n)]
        got = T.order(starts, numbers=[rng.choice([None, *range(6)]) for _ in range(n)])
        timed = [starts[i] for i in got if starts[i] is not None]
        assert sorted(got) == list(range(n)) and timed == sorted(timed)


def test_refused_edges_are_those_of_cycles():
    rng = random.Random(8)
    for _ in range(200):
        n, kept = rng.randrange(2, 9), []
        graph = T.Order(n)
        for _ in range(20):
            a, b = rng.randrange(n), rng.randrange(n)
            reach, todo = {b}, [b]
            while todo:
                x = todo.pop()
                for p, q in kept:
                    if p == x and q not in reach:
                        reach.add(q)
                        todo.append(q)
            if a != b:
                assert graph.add(a, b) == (a not in reach)
                kept += [(a, b)] * (a not in reach)
        assert all(graph.at[p] < graph.at[q] for p, q in kept) and sorted(graph.at) == list(range(n))


def test_long_file(spark):
    content = "\n".join(f"{'Ana Lopes' if i % 2 else 'Jo Brandt'}: words {i}" for i in range(20_000))
    files = spark.createDataFrame([(1, None, None, content, "x"), (2, None, None, None, "x"), (3, None, None, "Ana: a", "x"), (3, None, None, "Ana: a", "x")], "id long, mime_type string, source_url string, content string, text string")
    people = spark.createDataFrame([(t, *p) for t in (1, 2, 3) for p in PEOPLE], "transcript_id long, speaker_no int, speaker_name string, speaker_role string")
    got = T.turns(files, people)
    assert got.filter("transcript_id = 1").count() == 20_000
    assert [r.turn_no for r in got.filter("transcript_id = 3").collect()] == [1, 1]
    assert T.turns(files.limit(0), people).count() == 0 and T.turns(files, people.limit(0)).count() == 0
