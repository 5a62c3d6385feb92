"""Parsed sentences that queries and tests of the rules run on, in the short notation of sources.parses."""

from __future__ import annotations

SENTENCES = [
    "The_DT_det_2 function_NN_nsubj_3 sorts=sort_VBZ_ROOT_3 the_DT_det_5 array_NN_dobj_3 ~._._punct_3",
    "The_DT_det_2 function_NN_nsubj_3 sorted=sort_VBD_ROOT_3 the_DT_det_5 array_NN_dobj_3 ~._._punct_3",
    "The_DT_det_2 functions=function_NNS_nsubj_3 sort_VBP_ROOT_3 the_DT_det_5 array_NN_dobj_3 ~._._punct_3",
    "I_PRP_nsubj_2 sort_VBP_ROOT_2 the_DT_det_4 array_NN_dobj_2 ~._._punct_2",
    "They_PRP_nsubj_2 solved=solve_VBD_ROOT_2 the_DT_det_4 problem_NN_dobj_2 ~._._punct_2",
    "The_DT_det_2 parser_NN_nsubj_3 went=go_VBD_ROOT_3 wrong_JJ_acomp_3 ~._._punct_3",
    "Sort=sort_VB_ROOT_1 the_DT_det_3 array_NN_dobj_1 ~._._punct_1",
    "He_PRP_nsubj_3 always_RB_advmod_3 arrives=arrive_VBZ_ROOT_3 early_RB_advmod_3 ~._._punct_3",
    "She_PRP_nsubj_3 has=have_VBZ_aux_3 finished=finish_VBN_ROOT_3 the_DT_det_5 report_NN_dobj_3 ~._._punct_3",
    "The_DT_det_2 model_NN_nsubj_4 can_MD_aux_4 handle_VB_ROOT_4 noise_NN_dobj_4 ~._._punct_4",
    "The_DT_det_2 parser_NN_nsubj_4 must_MD_aux_4 handle_VB_ROOT_4 noise_NN_dobj_4 ~._._punct_4",
    "The_DT_det_2 task_NN_nsubj_3 is=be_VBZ_ROOT_3 simple_JJ_acomp_3 ~._._punct_3",
    "The_DT_det_2 task_NN_nsubj_3 is=be_VBZ_ROOT_3 impossible_JJ_acomp_3 ~._._punct_3",
    "The_DT_det_2 result_NN_nsubj_3 is=be_VBZ_ROOT_3 important_JJ_acomp_3 ~._._punct_3",
    "The_DT_det_2 result_NN_nsubj_3 is=be_VBZ_ROOT_3 unimportant_JJ_acomp_3 ~._._punct_3",
    "The_DT_det_2 check_NN_nsubj_3 is=be_VBZ_ROOT_3 useful_JJ_acomp_3 ~._._punct_3",
    "The_DT_det_2 system_NN_nsubj_3 has=have_VBZ_ROOT_3 redundancy_NN_dobj_3 ~._._punct_3",
    "The_DT_det_2 system_NN_nsubj_3 lacks=lack_VBZ_ROOT_3 redundancy_NN_dobj_3 ~._._punct_3",
    "The_DT_det_2 parser_NN_nsubj_3 runs=run_VBZ_ROOT_3 with_IN_prep_3 a_DT_det_6 cache_NN_pobj_4 ~._._punct_3",
    "The_DT_det_2 parser_NN_nsubj_3 runs=run_VBZ_ROOT_3 without_IN_prep_3 a_DT_det_6 cache_NN_pobj_4 ~._._punct_3",
    "The_DT_det_2 function_NN_nsubj_3 fails=fail_VBZ_ROOT_3 to_TO_aux_5 sort_VB_xcomp_3 the_DT_det_7 array_NN_dobj_5 ~._._punct_3",
    "He_PRP_nsubj_2 denies=deny_VBZ_ROOT_2 taking=take_VBG_xcomp_2 the_DT_det_5 money_NN_dobj_3 ~._._punct_2",
    "Some_DT_det_2 students=student_NNS_nsubj_3 solved=solve_VBD_ROOT_3 the_DT_det_5 problem_NN_dobj_3 ~._._punct_3",
    "All_PDT_predet_3 the_DT_det_3 students=student_NNS_nsubj_4 passed=pass_VBD_ROOT_4 the_DT_det_6 exam_NN_dobj_4 ~._._punct_4",
    "Everyone_NN_nsubj_2 passed=pass_VBD_ROOT_2 the_DT_det_4 exam_NN_dobj_2 ~._._punct_2",
    "Not_RB_neg_2 everyone_NN_nsubj_3 passed=pass_VBD_ROOT_3 the_DT_det_5 exam_NN_dobj_3 ~._._punct_3",
    "Everyone_NN_nsubj_4 did=do_VBD_aux_4 not_RB_neg_4 pass_VB_ROOT_4 the_DT_det_6 exam_NN_dobj_4 ~._._punct_4",
    "No_DT_det_2 students=student_NNS_nsubj_3 passed=pass_VBD_ROOT_3 ~._._punct_3",
    "Neither_DT_det_2 test_NN_nsubj_3 passed=pass_VBD_ROOT_3 ~._._punct_3",
    "No_DT_det_2 one_NN_nsubj_3 passed=pass_VBD_ROOT_3 the_DT_det_5 exam_NN_dobj_3 ~._._punct_3",
    "He_PRP_nsubj_3 rarely_RB_advmod_3 arrives=arrive_VBZ_ROOT_3 early_RB_advmod_3 ~._._punct_3",
    "He_PRP_nsubj_3 never_RB_neg_3 calls=call_VBZ_ROOT_3 ~._._punct_3",
    "The_DT_det_2 scheduler_NN_nsubj_5 does=do_VBZ_aux_5 not_RB_neg_5 run_VB_ROOT_5 the_DT_det_7 process_NN_dobj_5 ~._._punct_5",
    "The_DT_det_2 kernel_NN_nsubj_5 did=do_VBD_aux_5 not_RB_neg_5 run_VB_ROOT_5 the_DT_det_7 job_NN_dobj_5 ~._._punct_5",
    "The_DT_det_2 process_NN_nsubj_5 ca=can_MD_aux_5 ~n't=not_RB_neg_5 access_VB_ROOT_5 the_DT_det_7 memory_NN_dobj_5 ~._._punct_5",
    "The_DT_det_2 pages=page_NNS_nsubjpass_5 were=be_VBD_auxpass_5 not_RB_neg_5 loaded=load_VBN_ROOT_5 ~._._punct_5",
    "Delhi_NNP_nsubj_2 is=be_VBZ_ROOT_2 not_RB_neg_2 the_DT_det_5 capital_NN_attr_2 of_IN_prep_5 India_NNP_pobj_6 ~._._punct_2",
    "The_DT_det_2 function_NN_nsubj_5 does=do_VBZ_aux_5 not_RB_neg_5 fail_VB_ROOT_5 to_TO_aux_7 sort_VB_xcomp_5 the_DT_det_9 array_NN_dobj_7 ~._._punct_5",
    "The_DT_det_2 protocol_NN_nsubj_3 is=be_VBZ_ROOT_3 unreliable_JJ_acomp_3 ~._._punct_3",
    "It_PRP_nsubj_2 is=be_VBZ_ROOT_2 not_RB_neg_2 unusual_JJ_acomp_2 ~._._punct_2",
    "Does=do_VBZ_aux_3 it_PRP_nsubj_3 compile_VB_ROOT_3 ~?_._punct_3",
    "Is=be_VBZ_ROOT_1 the_DT_det_3 task_NN_nsubj_1 impossible_JJ_amod_3 ~?_._punct_1",
    "There_EX_expl_2 is=be_VBZ_ROOT_2 a_DT_det_4 solution_NN_attr_2 ~._._punct_2",
    "This_DT_det_2 parser_NN_nsubj_3 is=be_VBZ_ROOT_3 faster=fast_JJR_acomp_3 than_IN_prep_4 the_DT_det_8 old_JJ_amod_8 one_NN_pobj_5 ~._._punct_3",
    "If_IN_mark_4 the_DT_det_3 test_NN_nsubj_4 passes=pass_VBZ_advcl_8 ~,_,_punct_8 the_DT_det_7 build_NN_nsubj_8 succeeds=succeed_VBZ_ROOT_8 ~._._punct_8",
    "If_IN_mark_4 the_DT_det_3 test_NN_nsubj_4 passes=pass_VBZ_advcl_10 ~,_,_punct_10 the_DT_det_7 build_NN_nsubj_10 does=do_VBZ_aux_10 not_RB_neg_10 succeed_VB_ROOT_10 ~._._punct_10",
    "The_DT_det_2 function_NN_nsubj_3 sorts=sort_VBZ_ROOT_3 the_DT_det_5 array_NN_dobj_3 and_CC_cc_3 returns=return_VBZ_conj_3 the_DT_det_9 result_NN_dobj_7 ~._._punct_3",
    "The_DT_det_2 result_NN_nsubj_3 is=be_VBZ_ROOT_3 important_JJ_acomp_3 and_CC_cc_3 the_DT_det_7 method_NN_nsubj_8 works=work_VBZ_conj_3 ~._._punct_3",
    "The_DT_det_2 parser_NN_nsubj_7 that_WDT_nsubj_5 can_MD_aux_5 handle_VB_relcl_2 noise_NN_dobj_5 sorts=sort_VBZ_ROOT_7 the_DT_det_9 array_NN_dobj_7 ~._._punct_7",
    "What_WP_det_3 a_DT_det_3 mess_NN_attr_5 this_DT_nsubj_5 is=be_VBZ_ROOT_5 ~!_._punct_5",
    "The_DT_det_2 build_NN_nsubj_3 seems=seem_VBZ_ROOT_3 stable_JJ_oprd_3 ~._._punct_3",
    "The_DT_det_2 function_NN_nsubj_6 probably_RB_advmod_6 does=do_VBZ_aux_6 not_RB_neg_6 sort_VB_ROOT_6 the_DT_det_8 array_NN_dobj_6 ~._._punct_6",
    "The_DT_det_2 function_NN_nsubj_6 definitely_RB_advmod_6 does=do_VBZ_aux_6 not_RB_neg_6 sort_VB_ROOT_6 the_DT_det_8 array_NN_dobj_6 ~._._punct_6",
    "The_DT_det_2 result_NN_nsubj_3 is=be_VBZ_ROOT_3 anything_NN_attr_3 but_IN_prep_4 simple_JJ_pobj_5 ~._._punct_3",
    "The_DT_det_2 function_NN_nsubj_4 never_RB_neg_4 fails=fail_VBZ_ROOT_4 to_TO_aux_6 sort_VB_xcomp_4 the_DT_det_8 array_NN_dobj_6 ~._._punct_4",
    "The_DT_det_2 function_NN_nsubj_5 does=do_VBZ_aux_5 not_RB_neg_5 sort_VB_ROOT_5 the_DT_det_7 array_NN_dobj_5 and_CC_cc_5 does=do_VBZ_aux_11 not_RB_neg_11 return_VB_conj_5 the_DT_det_13 result_NN_dobj_11 ~._._punct_5",
    "The_DT_det_2 task_NN_nsubj_3 is=be_VBZ_ROOT_3 not_RB_neg_3 impossible_JJ_acomp_3 ~._._punct_3",
]

#: Antonyms (lemma, part of speech, antonym) that the sentences need besides what affixes give.
ANTONYMS = [
    ("simple", "ADJ", "complex"), ("important", "ADJ", "unimportant"), ("useful", "ADJ", "useless"), ("fast", "ADJ", "slow"), ("pass", "VERB", "fail"),
    ("early", "ADV", "late"),
]
