"""What source code does, by the names that it uses: one pattern a signal, for any case of letters and with ^ and $ at lines."""

from __future__ import annotations

# The names of the signals. The patterns are made of the public names of languages, libraries and frameworks.
SIGNALS: dict[str, str] = {
    "exception_handlers": r"\bexcept\b[^\n]*:|\bcatch\s*[({]|\brescue\b|\brecover\(\)|\bset_exception_handler\b",
    "discards_error": r"\bexcept\b[^\n:]*:\s*pass\b|\bcatch\s*\([^)\n]*\)\s*\{\s*\}|\brescue\s+nil\b",
    "logs_in_handler": r"\blogger\.exception\(|\blogging\.exception\(|\bexc_info\s*=\s*true|\bcatch\s*\([^)\n]*\)\s*\{\s*(?:console|log|logger)\.",
    "threads": r"\bthreading\.|\bstd::thread\b|\bpthread_create\b|\bnew thread\b|\bimplements runnable\b",
    "async": r"\basync\s+(?:def|fn|function)\b|\bawait\s|\basyncio\.",
    "subprocess": r"\bsubprocess\.|\bos\.system\(|\bchild_process\b|\bprocessbuilder\b|\bexec\.command\(|\bprocess\.start\(",
    "existing_logging": r"\bgetlogger\(|\bimport logging\b|\blog4j\b|\bslf4j\b|\bwinston\b|\blog\.printf\(|\btracing::",
    "prints_only": r"^\s*print\(|\bconsole\.log\(|\bsystem\.out\.print|\bfmt\.print|\bprintln!",
    "gui_toolkit": r"\btkinter\b|\bpyqt[56]?\b|\bpyside[26]?\b|\bwxpython\b|\bgtk\.|\bjavafx\b|\bjavax\.swing\b|\bimgui\b",
    "web_service": r"\bflask\b|\bfastapi\b|\bdjango\b|\bexpress\(\)|\bspringboot|\bactix_web\b|\bgin\.default\(|\baspnetcore\b",
    "network_io": r"\brequests\.(?:get|post)\(|\burllib\b|\bhttpx\.|\bfetch\(|\baxios\b|\bhttpclient\b|\bnet/http\b|\breqwest\b",
    "file_io": r"\bopen\([^)\n]*['\"][rwa]b?\+?['\"]|\bfs\.(?:readfile|writefile)|\bfileinputstream\b|\bioutil\.readfile\b|\bfopen\(|\bpathlib\b",
    "broker_or_queue_consumer": r"\bkafkaconsumer\b|\bbasic_consume\b|\bcelery\b|\bpubsub\b|\bsqs\b|\bnats\.connect\b|\bamqplib\b",
    "browser_entry_point": r"<!doctype html|<html\b|\breactdom\.(?:render|createroot)\b|\bcreateapp\(",
    "browser_only_transport": r"\bnew websocket\(|\bnew eventsource\(|\bxmlhttprequest\b|\bnavigator\.sendbeacon\b",
    "cli_arg_parser": r"\bargparse\b|\bclick\.command\b|\bclap::|\bflag\.parse\(\)|\byargs\b|\bgetopt\b|\bcobra\.command\b",
    "client_error_boundary": r"\bcomponentdidcatch\b|\bgetderivedstatefromerror\b|\berrorboundary\b|\bwindow\.onerror\b|\berrorcaptured\b",
    "client_error_reporting_present": r"\bsentry\.init\b|\bbugsnag\b|\brollbar\b|\btrackjs\b|\bdatadogrum\b",
    "csp_policy": r"\bcontent-security-policy\b",
    "display_forced_headless": r"\bqt_qpa_platform\b|\bsdl_videodriver\b|\bjava\.awt\.headless\b|--headless\b|\bxvfb\b",
    "dom_api_access": r"\bdocument\.(?:getelementbyid|queryselector|createelement)\b|\.innerhtml\b|\bdocument\.body\b",
    "dom_input_listener": r"\baddeventlistener\(\s*['\"](?:click|key|mouse|touch|pointer)|\bonclick\s*=|\bonkeydown\s*=",
    "electron_main_process": r"\bbrowserwindow\b|\bipcmain\b|\bapp\.whenready\(",
    "embedded_webview_ui": r"\bwebview\.create_window\b|\bqwebengineview\b|\bwebview2\b|\bwkwebview\b|\btauri::",
    "engine_frame_callback": r"\bvoid update\(\)|\bfunc _process\b|\brequestanimationframe\b|\bpygame\.display\.flip\b|\btick\(float\b",
    "error_to_stderr_only": r"\bsys\.stderr\b|\bconsole\.error\(|\bfprintf\(stderr\b|\beprintln!|\bos\.stderr\b|\bstd::cerr\b",
    "event_loop_runner": r"\basyncio\.run\(|\brun_until_complete\b|\brun_forever\(|\.mainloop\(|\btokio::main\b|\bapp\.exec_?\(\)",
    "fatal_signal_handling": r"\bsignal\.signal\(|\bsigaction\b|\bfaulthandler\b|\bsetunhandledexceptionfilter\b|\bprocess\.on\(\s*['\"]sig",
    "frame_present": r"\bswapbuffers\b|\bvkqueuepresentkhr\b|\bidxgiswapchain\b|\bpresentdrawable\b|\bglutswapbuffers\b",
    "framework_error_middleware": r"\berrorhandler\(|\bexception_handler\(|\bcontrolleradvice\b|\bapp\.use\(\s*\(err\b|\brescue_from\b",
    "frontend_dev_server": r"\bwebpack-dev-server\b|\bvite\b|\bnext dev\b|\breact-scripts start\b|\bng serve\b",
    "game_loop_input": r"\bpygame\.event\.get\b|\binput\.getkey|\bsdl_pollevent\b|\bglfwgetkey\b|\bis_action_pressed\b",
    "global_input_hook": r"\bpynput\b|\bsetwindowshookex\b|\bcgeventtapcreate\b|\biohook\b|\bevdev\b",
    "goroutines": r"\bgo func\(|\bsync\.waitgroup\b|\berrgroup\.",
    "gpu_api": r"\bvulkan\b|\bd3d1[12]\b|\bmetalkit\b|\bwebgl2?\b|\bwebgpu\b|\bopengl\b|\bcuda[a-z]*\(",
    "gui_framework_error_hook": r"\breport_callback_exception\b|\bsys\.excepthook\b|\bdispatcherunhandledexception\b|\bapplication\.threadexception\b",
    "gui_modal_dialog": r"\bmessagebox\b|\bqmessagebox\b|\bjoptionpane\b|\bshowdialog\(|\bnsalert\b",
    "gui_window_created": r"\btk\.tk\(\)|\bqmainwindow\b|\bnew jframe\b|\bcreatewindowex[aw]?\b|\bglfwcreatewindow\b|\bsdl_createwindow\b|\bnswindow\b",
    "http_route_handlers": r"@app\.(?:route|get|post)\(|\brouter\.(?:get|post)\(|@(?:get|post|request)mapping\b|\bhandlefunc\(",
    "input_permission_gate": r"\baxisprocesstrusted\b|\bioHIDrequestaccess\b|\bnsinputmonitoringusagedescription\b",
    "jvm_dotnet_log_backend": r"\blogback\b|\blog4j2?\b|\bserilog\b|\bnlog\b|\bilogger<",
    "launch_surface": r"\bif __name__ == ['\"]__main__['\"]|\bpublic static void main\b|\bfunc main\(\)|\bfn main\(\)|\bint main\(",
    "logging_reconfigured": r"\blogging\.basicconfig\(|\bdictconfig\(|\bfileconfig\(|\blogger\.remove\(\)|\bsetloglevel\(",
    "logs_to_file": r"\bfilehandler\(|\brotatingfilehandler\b|\bfileappender\b|\btransports\.file\b|\blogger\.add\(",
    "memory_unsafe_code": r"\bunsafe\s*\{|\bmalloc\(|\bstrcpy\(|\breinterpret_cast<|\bunsafe\.pointer\b",
    "native_call_boundary": r"\bctypes\b|\bcffi\b|\bdllimport\b|\bextern \"c\"|\bjniexport\b|\bnapi_",
    "native_callback": r"\bcfunctype\b|\bwinfunctype\b|\bwndproc\b|\bunmanagedfunctionpointer\b",
    "native_log_framework": r"\bspdlog\b|\bglog\b|\bboost::log\b|\beasylogging\b|\bqdebug\(\)",
    "nonpython_error_discard": r"\b_\s*=\s*err\b|\bcatch\s*\{\s*\}|\bon error resume next\b|\.catch\(\(\)\s*=>\s*\{\s*\}\)|\blet _ =",
    "platform_system_log": r"\bsyslog\(|\bos_log\b|\boutputdebugstring|\beventlog\b|\bsd_journal_",
    "process_fanout": r"\bmultiprocessing\b|\bprocesspoolexecutor\b|\bfork\(\)|\bcluster\.fork\b|\bmpi_init\b",
    "py_silent_suppression": r"\bcontextlib\.suppress\b|\bexcept\s*:\s*$|\bwarnings\.filterwarnings\(\s*['\"]ignore",
    "py_stdlib_logging": r"^\s*import logging\b|^\s*from logging\b|\blogging\.(?:debug|info|warning|error|critical)\(",
    "raw_socket_ipc": r"\bsocket\.socket\(|\bnamed_?pipe\b|\baf_unix\b|\bzmq\b|\bshm_open\b",
    "resident_loop_or_scheduler": r"\bwhile true\b|\bapscheduler\b|\bschedule\.every\b|\bsetinterval\(|\btime\.tick\(",
    "rpc_framework": r"\bgrpc\b|\bthrift\b|\bjsonrpc\b|\bxmlrpc\b|\btonic::",
    "scheduled_by_timer": r"\bcrontab\b|\bcron\.schedule\b|@scheduled\b|\boncalendar=|\bk8s cronjob\b",
    "server_listen_loop": r"\.listen\(\d*|\blistenandserve\b|\bserve_forever\b|\btcplistener\b|\buvicorn\.run\b",
    "ssr_meta_framework": r"\bgetserversideprops\b|\bnuxt\b|\bsveltekit\b|\bremix-run\b|\bastro\.config\b",
    "stdin_line_prompt": r"\binput\(['\"]|\breadline\(\)|\bscanner\(system\.in\)|\bbufio\.newscanner\(os\.stdin\)|\bread_line\(",
    "synthetic_input_driver": r"\bpyautogui\b|\bselenium\b|\bplaywright\b|\bsendinput\b|\bxdotool\b",
    "terminal_key_input": r"\bcurses\b|\btermios\b|\bmsvcrt\.getch\b|\bprompt_toolkit\b|\bcrossterm\b",
    "text_entry_fields": r"\bqlineedit\b|\bjtextfield\b|\btk\.entry\b|<input\b|<textarea\b|\btextfield\(",
    "thread_pool_futures": r"\bthreadpoolexecutor\b|\bcompletablefuture\b|\bexecutorservice\b|\bstd::async\b|\brayon::",
    "thread_spawn": r"\bthread::spawn\b|\bthread\(target=|\bstart_new_thread\b|\bdispatch_async\b|\btask\.run\(",
    "toolkit_input_handler": r"\bkeypressevent\b|\bmousepressevent\b|\bkeylistener\b|\.bind\(\s*['\"]<|\bon_key_press\b",
    "unawaited_task": r"\bcreate_task\(|\bensure_future\(|\btokio::spawn\b|\bfire_and_forget\b",
    "workflow_engine_task": r"\bairflow\b|\bprefect\b|\bluigi\b|\bdagster\b|\btemporalio\b",
    "error_to_default_value": r"\bunwrap_or(?:_default|_else)?\(|\bexcept\b[^\n:]*:\s*return (?:none|false|0|\[\]|\{\})|\bor_else\(|\bgetordefault\(",
    "mobile_app_ui": r"\buiviewcontroller\b|\bswiftui\b|\bjetpack compose\b|@composable\b|\bandroid\.app\b|\breact-native\b|\bflutter\b",
    "gpu_from_managed_runtime": r"\bcupy\b|\bpycuda\b|\btorch\.cuda\b|\bjcuda\b|\bilgpu\b|\bnumba\.cuda\b",
}
